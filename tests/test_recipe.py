import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import by_id, spectra_of
from spectraloom.functions import spectrum
from spectraloom.operators import recipe
from spectraloom.operators.recipe import Step


def matrix(spectra):
    return np.array(by_id(spectra.signal()).y.tolist())


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1, (17, 25))
    x[4] = 1.5  # flat row
    axis = np.linspace(400, 1000, 25)
    return x, axis, spectra_of(spark, x, axis)


def test_step_order_matters(sample):
    _, _, s = sample
    a, _ = recipe.apply_recipe(s, [Step("SNV"), Step("Derivative")])
    b, _ = recipe.apply_recipe(s, [Step("Derivative"), Step("SNV")])
    assert not np.allclose(matrix(a), matrix(b))


def test_range_uses_the_physical_axis(sample):
    x, axis, s = sample
    out, _ = recipe.apply_recipe(s, [Step("Range", {"minimum": 500, "maximum": 700})])
    kept = (axis >= 500) & (axis <= 700)
    assert np.array_equal(out.axis, axis[kept]) and np.array_equal(matrix(out), x[:, kept])
    with pytest.raises(ValueError):
        recipe.apply_recipe(s, [Step("Range", {"minimum": 500, "maximum": 510})])


def test_row_steps_match_numpy_and_native_columns(sample):
    x, axis, s = sample
    sd = x.std(axis=1, keepdims=True)
    snv = (x - x.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1, sd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    area = x / np.trapezoid(np.abs(x), axis, axis=1)[:, None]
    for name, expected, column in (
        ("SNV", snv, spectrum.snv(F.col("y"))),
        ("Vector normalize", unit, spectrum.vector_normalize(F.col("y"))),
        ("Area normalize", area, spectrum.area_normalize(F.col("y"), axis)),
    ):
        out, _ = recipe.apply_recipe(s, [Step(name)])
        assert np.allclose(matrix(out), expected, atol=1e-12), name
        assert np.allclose(matrix(s.with_y(column)), expected, atol=1e-12), name


def test_fitted_steps_match_numpy_and_freeze(spark, sample):
    x, axis, s = sample
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    for name, shift, scale in (
        ("Mean center", x.mean(0), np.ones(25)),
        ("Autoscale", x.mean(0), x.std(0)),
        ("Robust scale", q[1], q[2] - q[0]),
    ):
        out, state = recipe.apply_recipe(s, [Step(name)])
        assert np.allclose(matrix(out), (x - shift) / scale, atol=1e-10)
        other = spectra_of(spark, x[:3] + 5, axis)
        frozen, _ = recipe.apply_recipe(other, [Step(name)], state)
        assert np.allclose(matrix(frozen), (x[:3] + 5 - shift) / scale, atol=1e-10)


def test_gaps_are_filled_with_column_medians(spark):
    x = np.arange(24.0).reshape(6, 4)
    x[1, 2] = x[4, 0] = np.nan
    s = spectra_of(spark, x, np.arange(4.0))
    fitted = recipe.fit_recipe(s, [Step("Mean center")])
    med = np.nanmedian(x, axis=0)
    full = np.where(np.isnan(x), med, x)
    assert np.allclose(matrix(fitted.transform(s)), full - full.mean(0))


def test_json_description_and_ordering():
    steps = [Step("SNV"), Step("Range", {"minimum": 1.0, "maximum": 2.0}), Step("Autoscale", {}, False)]
    assert recipe.from_json(recipe.to_json(steps)) == steps
    assert recipe.describe(steps) == "SNV → Range (minimum=1.0, maximum=2.0)"
    assert [s.name for s in recipe.ordered_steps(steps)] == ["Range", "SNV", "Autoscale"]
    assert recipe.complexity(steps) == 1 and recipe.uses_snv(steps)


def test_candidates_have_snv_and_plain_versions():
    axis = np.linspace(400, 1800, 80)
    named = recipe.candidate_recipes(axis)
    assert len(named) == 10 and len(recipe.candidate_recipes(axis[:20])) == 9
    assert 0 < sum(recipe.uses_snv(s) for _, s in named) < len(named)
    assert all(s[0].name == "Range" and s[-1].name == "Mean center" for _, s in named)
    base = [Step("SNV"), Step("Autoscale")]
    assert recipe.search_recipes(axis, base)[0][0] == "Current expert recipe"
    assert len(recipe.search_recipes(axis, named[0][1])) == 10


def test_exclusion_and_selection(spark):
    import pandas as pd

    meta = pd.DataFrame({"Brand": list("ABAB"), "Station": list("abab")})
    s = spectra_of(spark, np.arange(24.0).reshape(4, 6), np.arange(6.0), meta)
    kept, info = s.exclude("1-2, 2-3")
    assert list(kept.axis) == [0, 4, 5] and (info.removed, info.retained) == (3, 3)
    assert np.array_equal(matrix(kept), np.arange(24.0).reshape(4, 6)[:, [0, 4, 5]])
    with pytest.raises(ValueError, match="at least two must remain"):
        s.exclude("0-4")
    assert list(by_id(s.select_rows("B b").df).sample_index) == [1, 3]
    assert list(by_id(s.select_rows("b B", include=False).df).sample_index) == [0, 2]


def test_recipe_as_pipeline_stage(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from spectraloom.operators.recipe_stage import RecipeEstimator

    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 6))
    x[3, 2] = np.nan
    s = spectra_of(spark, x, np.arange(400.0, 406.0))
    steps = [Step("Range", {"minimum": 401.0, "maximum": 405.0}), Step("SNV"), Step("Autoscale")]
    model = Pipeline(stages=[RecipeEstimator.of(s.axis, steps, outputCol="z")]).fit(s.df)
    want = recipe.fit_recipe(s, steps).transform(s).df.orderBy("sample_index").collect()
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        got = m.transform(s.df).orderBy("sample_index").collect()
        assert np.allclose([r["z"] for r in got], [r["y"] for r in want]) and m.stages[0].fitted().axis.tolist() == [401, 402, 403, 404, 405]


def test_infinite_cells_are_missing(spark):
    x = np.arange(30.0).reshape(6, 5)
    x[1, 2], x[2, 2] = np.inf, -np.inf
    s = spectra_of(spark, x, np.arange(5.0))
    assert s.profile().incomplete == 2
    filled = recipe.fit_recipe(s, [Step("Range", {"minimum": 0.0, "maximum": 4.0})]).transform(s)
    got = np.array([r["y"] for r in filled.df.orderBy("sample_index").collect()])
    assert np.isfinite(got).all() and got[1, 2] == np.median([2.0, 17.0, 22.0, 27.0])
