"""CSV spectra: two layouts, one array column out.

Header layout: every header that reads as a number is an axis point.  Marker layout: the
first data cell mentions "wavenumber", the first data row carries the axis from column 8 on
and columns 2-7 are metadata.  Numeric cells are packed into one array at read time, so a
file with thousands of axis points never becomes thousands of downstream columns.
"""

from __future__ import annotations

import csv
import math
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metadata import NUMERIC_TEXT
from ..spectra import ID, Y, Spectra

# Fallback metadata names, marker layout offsets, texts read as missing.
FALLBACK_NAMES = ("SampleID", "Brand", "Grade", "City", "State", "Year")
MARKER = "wavenumber"
META_START, AXIS_START = 1, 7
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _number(text: object) -> float | None:
    try:
        return float(str(text).strip())
    except ValueError:
        return None


def usable_headers(headers: list[str], count: int) -> list[str]:
    """Keep real header names; fall back to standard ones when none is informative."""
    names = [str(h).strip() for h in headers[:count]]

    def blank(name: str) -> bool:
        return not name or name.lower().startswith("unnamed:")

    def uninformative(name: str) -> bool:
        return blank(name) or name.replace(".", "", 1).isdigit() and name[0] != "." and name[-1] != "."

    numbered = [f"Metadata_{i + 1}" for i in range(count)]
    if names and not all(map(uninformative, names)):
        return [numbered[i] if blank(n) else n for i, n in enumerate(names)]
    return [*FALLBACK_NAMES[:count], *numbered[len(FALLBACK_NAMES) :]][:count]


def _unique(names: list[str]) -> list[str]:
    """Repeated headers get ``.1``, ``.2`` suffixes; empty ones an ``Unnamed`` name."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        name = name or f"Unnamed: {i}"
        repeat = seen.get(name, 0)
        seen[name] = repeat + 1
        out.append(f"{name}.{repeat}" if repeat else name)
    return out


def _cell(column: Column) -> Column:
    """Numeric cell or null."""
    return F.when(column.rlike(NUMERIC_TEXT), column.try_cast("double"))


def _text(column: Column) -> Column:
    return F.when(~F.trim(column).isin(*MISSING_TEXTS), column)


def with_row_index(df: DataFrame, out: str = ID) -> DataFrame:
    """Contiguous 0-based index by file path and place in the file, and whether a row is its file's first.

    ``df`` has the source's ``_file`` and ``_start`` (of the split).  A split's rows keep their order in
    one partition, so its number of rows places all that follow.
    """
    place = df.withColumn("_m", F.monotonically_increasing_id())
    splits = place.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("c"), F.min("_m").alias("low"))
    offsets, total, last = [], 0, None
    for r in splits.orderBy("_file", "_start").collect():  # one row per input split
        offsets.append((r["_file"], r["_start"], total - r["low"], r["low"] if r["_file"] != last else -1))
        total, last = total + r["c"], r["_file"]
    table = df.sparkSession.createDataFrame(offsets, "_file string, _start bigint, _off bigint, _top bigint")
    return (
        place.join(F.broadcast(table), ["_file", "_start"])
        .withColumn(out, F.col("_off") + F.col("_m"))
        .withColumn("_first", F.col("_m") == F.col("_top"))
        .drop("_m", "_off", "_top")
    )


@dataclass(frozen=True)
class Layout:
    """What the first two lines of a file say: its columns, and which are metadata and axis points."""

    header: tuple[str, ...]
    marker: bool
    meta: tuple[tuple[int, str], ...]
    axis: tuple[tuple[float, int], ...]

    @property
    def points(self) -> list[float]:
        return [v for v, _ in self.axis]


def layout_of(lines: list[str]) -> Layout:
    header = _unique(next(csv.reader([lines[0]])))
    sample = next(csv.reader([lines[1]])) if len(lines) > 1 else []
    marker = bool(sample) and _number(sample[0]) is None and MARKER in sample[0].lower()
    if marker:
        axis = [(i, _number(sample[i]) if i < len(sample) else None) for i in range(AXIS_START, len(header))]
        count = min(AXIS_START, len(header)) - META_START
        names = usable_headers(header[META_START:AXIS_START], count)
        meta = [(META_START + i, name) for i, name in enumerate(names)]
    else:
        axis = [(i, v) for i, h in enumerate(header) if (v := _number(h)) is not None]
        if not axis:
            raise ValueError("No numeric wavenumber columns detected.")
        spectral = {i for i, _ in axis}
        meta = [(i, h) for i, h in enumerate(header) if i not in spectral]
    kept = sorted(((v, i) for i, v in axis if v is not None and math.isfinite(v)), key=lambda p: p[0])
    return Layout(tuple(header), marker, tuple(meta), tuple(kept))


def layouts_of(spark: SparkSession, path: str) -> dict[Layout, list[str]]:
    """The files of a path by layout; two lines of each file come to the driver."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    tagged = lines.filter("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
    tops = tagged.groupBy("file_path").agg(F.min("at").alias("top")).collect()
    if not tops:
        raise ValueError("No numeric wavenumber columns detected.")
    side = spark.createDataFrame([(r["file_path"], r["top"]) for r in tops], "file_path string, top bigint")
    heads = (
        tagged.join(F.broadcast(side), "file_path")
        .filter("at <= top + 1")
        .select("file_path", (F.col("at") - F.col("top")).alias("n"), "value")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for r in sorted(heads, key=lambda r: (r["file_path"], r["n"])):
        found.setdefault(r["file_path"], []).append(r["value"])
    out: dict[Layout, list[str]] = {}
    for file, first in found.items():
        out.setdefault(layout_of(first), []).append(file)
    return out


def load_csv(spark: SparkSession, path: str, index: str | None = None) -> Spectra:
    """Read the spectra of one CSV file, a folder or a pattern; files may order their columns differently.

    Columns are matched by name, metadata that a file lacks is null there, and all files must have
    the same axis.  ``index`` names an existing integer key column to use as sample index;
    otherwise rows are numbered by file path and place in the file.
    """
    layouts = layouts_of(spark, path)
    points = next(iter(layouts)).points
    if any(x.points != points for x in layouts):
        raise ValueError("The files have different wavenumber axes.")
    parts = []
    for at, (layout, files) in enumerate(layouts.items()):
        names = ", ".join(f"c{i} string" for i in range(len(layout.header)))
        raw = spark.read.csv(files, header=True, schema=names, enforceSchema=True)
        read = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
        parts.append(
            read.select(
                "_file",
                "_start",
                F.lit(layout.marker).alias("_marker"),
                *[_text(F.col(f"c{i}")).alias(name) for i, name in layout.meta],
                F.array(*[_cell(F.col(f"c{i}")) for _, i in layout.axis]).alias(Y),
            )
        )
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if index is None or any(x.marker for x in layouts):
        rows = with_row_index(rows, "_row").filter("NOT (_marker AND _first)")
        # axis rows are no samples: number again without the one before each later row of marker files
        if any(x.marker for x in layouts):
            rows = renumbered(rows, sorted((f, x.marker) for x, files in layouts.items() for f in files))
    key = F.col("_row") if index is None else F.col(f"`{index}`").cast("bigint")
    meta = [c for c in rows.columns if c not in ("_file", "_start", "_marker", "_first", "_row", ID, Y)]
    return Spectra(rows.select(key.alias(ID), *[F.col(f"`{c}`") for c in meta], Y), np.array(points))


def renumbered(rows: DataFrame, files: list[tuple[str, bool]]) -> DataFrame:
    """Row numbers less the axis rows of the row's file and of those before it; one line per file."""
    shift = list(accumulate(int(marker) for _, marker in files))
    side = rows.sparkSession.createDataFrame([(f, n) for (f, _), n in zip(files, shift)], "_file string, _shift bigint")
    return rows.join(F.broadcast(side), "_file").withColumn("_row", F.col("_row") - F.col("_shift")).drop("_shift")
