import numpy as np
import pytest

from conftest import by_id, spectra_of
from spectraloom.sources import sinks
from spectraloom.sources.spectra_csv import load_csv, usable_headers

HEADER = """Brand,900,Note,500.5,inf,700
A,3,x,1,9,2
"B, Inc",6,,oops,9,5
NA,9,z,7,9,
"""
MARKER = """Wavenumber,SampleID,Brand,Grade,City,State,Year,c1,c2,c3
Wavenumber (cm-1),,,,,,,1000,400,bad
x,s1,A,g,c,CA,2020,1,2,3
x,s2,B,g,c,CA,2021,4,,6
"""


def write(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_header_layout(spark, tmp_path):
    s = load_csv(spark, write(tmp_path, HEADER))
    assert list(s.axis) == [500.5, 700.0, 900.0] and s.meta == ("Brand", "Note")
    rows = by_id(s.df)
    assert list(rows.Brand) == ["A", "B, Inc", None] and list(rows.Note) == ["x", None, "z"]
    assert [list(y) for y in rows.y] == [[1, 2, 3], [None, 5, 6], [7, None, 9]] or np.isnan(rows.y[1][0])
    assert s.profile().incomplete == 2


def test_marker_layout(spark, tmp_path):
    s = load_csv(spark, write(tmp_path, MARKER))
    assert list(s.axis) == [400.0, 1000.0]
    assert s.meta == ("SampleID", "Brand", "Grade", "City", "State", "Year")
    rows = by_id(s.df)
    assert list(rows.sample_index) == [0, 1] and list(rows.SampleID) == ["s1", "s2"]
    assert list(rows.y[0]) == [2, 1] and rows.y[1][1] == 4


def test_no_spectral_column(spark, tmp_path):
    with pytest.raises(ValueError, match="No numeric wavenumber columns detected"):
        load_csv(spark, write(tmp_path, "a,b\n1,2\n"))


def test_header_repair():
    assert usable_headers(["Unnamed: 1", "2", "3.5"], 3) == ["SampleID", "Brand", "Grade"]
    assert usable_headers(["Maker", "Unnamed: 2", ""], 3) == ["Maker", "Metadata_2", "Metadata_3"]
    assert usable_headers(["1"] * 8, 8)[-2:] == ["Metadata_7", "Metadata_8"]


def test_round_trip_over_many_files(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(40, 5))
    s = spectra_of(spark, x, np.array([1.0, 2.5, 3.0, 4.0, 1e3]), partitions=4)
    target = str(tmp_path / "out")
    sinks.write_spectra(s, target)
    back = load_csv(spark, target, index="sample_index")
    assert np.allclose(np.array(by_id(back.df).y.tolist()), x) and np.array_equal(back.axis, s.axis)
    numbered = load_csv(spark, target)
    assert sorted(by_id(numbered.df).sample_index) == list(range(40))


def test_result_dir():
    assert sinks.result_dir("/data/run1.csv") == "/data/run1_results"


def _files(tmp_path, texts):
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_files_with_other_column_orders(spark, tmp_path):
    folder = _files(tmp_path, {
        "a.csv": "site,400,500,600\nx,1,2,3\n",
        "b.csv": "600,500,400,batch,site\n30,20,10,B,y\n3,2,1,C,z\n",
    })
    s = load_csv(spark, folder)
    got = by_id(s.df)
    assert s.axis.tolist() == [400, 500, 600] and got.sample_index.tolist() == [0, 1, 2]
    assert [list(y) for y in got.y] == [[1, 2, 3], [10, 20, 30], [1, 2, 3]]
    assert got.site.tolist() == ["x", "y", "z"] and got.batch.tolist() == [None, "B", "C"]


def test_several_marker_files(spark, tmp_path):
    head = "id,Sample,Brand,Grade,City,State,Year,p0,p1\nWavenumber,,,,,,,{},{}\n"
    folder = _files(tmp_path, {
        "a.csv": head.format(400, 500) + "r,s1,A,,,,2025,1,2\nr,s2,A,,,,2025,3,4\n",
        "b.csv": head.format(500, 400) + "r,s3,B,,,,2025,6,5\n",
        "c.csv": head.format(400, 500) + "r,s4,B,,,,2025,7,8\n",
    })
    s = load_csv(spark, folder)
    got = by_id(s.df)
    assert got.sample_index.tolist() == [0, 1, 2, 3] and got.Sample.tolist() == ["s1", "s2", "s3", "s4"]
    assert [list(y) for y in got.y] == [[1, 2], [3, 4], [5, 6], [7, 8]]


def test_other_axes_are_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="axes"):
        load_csv(spark, _files(tmp_path, {"a.csv": "400,500\n1,2\n", "b.csv": "400,501\n1,2\n"}))
    with pytest.raises(ValueError, match="No numeric"):
        load_csv(spark, _files(tmp_path, {"a.csv": "x,y\n1,2\n", "b.csv": "x,y\n1,2\n"}))
