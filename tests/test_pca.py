import numpy as np
import pandas as pd
import pytest

from conftest import by_id, spectra_of
from spectraloom.operators import pca, regions
from spectraloom.operators.recipe import Step
from spectraloom.spectra import Spectra

CENTER = [Step("Mean center")]


@pytest.fixture(scope="module")
def low_rank(spark):
    rng = np.random.default_rng(21)
    axis = np.linspace(700, 1800, 50)
    x = rng.normal(size=(30, 3)) @ rng.normal(size=(3, 50)) + rng.normal(0, 0.06, (30, 50))
    meta = pd.DataFrame({"site": [f"s{i % 6}" for i in range(30)]})
    return x, axis, spectra_of(spark, x, axis, meta)


def brute_cv(x, fold_of, nmax, prepare):
    press, tss, val = np.zeros(nmax), 0.0, []
    for f in np.unique(fold_of):
        train, test = prepare(x[fold_of != f], x[fold_of == f])
        mean = train.mean(0)
        _, _, vt = np.linalg.svd(train - mean, full_matrices=False)
        errors = []
        for k in range(1, nmax + 1):
            v = vt[:k].T
            r = (test - mean) - (test - mean) @ v @ v.T
            errors.append(np.sqrt((r**2).mean()))
            press[k - 1] += (r**2).sum()
        val.append(errors)
        tss += ((test - mean) ** 2).sum()
    return np.mean(val, axis=0), press, 1 - press / tss


def test_model_matches_svd(low_rank):
    x, _, s = low_rank
    model = pca.fit_pca(s, CENTER, 4)
    z = x - x.mean(0)
    _, sv, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(model.explained, sv[:4] ** 2 / 29)
    assert np.allclose(model.ratio, sv[:4] ** 2 / (sv**2).sum())
    scores = np.array(by_id(model.scores(s)).scores.tolist())
    assert np.allclose(np.abs(scores), np.abs(z @ vt[:4].T), atol=1e-9)
    d = pca.diagnostics(model, s)
    table = by_id(d.table)
    t2 = ((z @ vt[:4].T) ** 2 / (sv[:4] ** 2 / 29)).sum(1)
    q = ((z - z @ vt[:4].T @ vt[:4]) ** 2).sum(1)
    assert np.allclose(table.Hotelling_T2, t2) and np.allclose(table.Q_residual, q)
    assert d.t2_limit > 0 and d.q_limit > 0
    assert (table.review_flag == ((t2 > d.t2_limit) | (q > d.q_limit))).all()


def test_row_order_does_not_change_the_model(low_rank):
    x, axis, s = low_rank
    a = pca.fit_pca(s, CENTER, 3)
    b = pca.fit_pca(Spectra(s.df.repartition(7).orderBy("sample_index"), axis), CENTER, 3)
    assert np.allclose(a.loadings, b.loadings, atol=1e-9)


@pytest.mark.parametrize("group", [None, "site"])
def test_gram_cross_validation_equals_explicit_folds(low_rank, group):
    x, _, s = low_rank
    frame, best = pca.pca_cv(s, CENTER, 8, 4, group=group)
    assigned, _, _ = pca.assign_folds(s, 4, 30, group)
    fold_of = by_id(assigned.df.select("sample_index", "fold")).fold.to_numpy()
    if group:
        seen = by_id(assigned.df.select("sample_index", "site", "fold")).groupby("site").fold.nunique()
        assert (seen == 1).all()
    rmse, press, q2 = brute_cv(x, fold_of, 8, lambda a, b: (a, b))
    assert np.allclose(frame.RMSECV_X, rmse, rtol=1e-8)
    assert np.allclose(frame.PRESS_X, press, rtol=1e-8) and np.allclose(frame.Q2_X, q2, rtol=1e-8)
    low = frame.RMSECV_X.idxmin()
    limit = frame.RMSECV_X[low] + frame.RMSECV_X_SE[low]
    assert best == frame.components[frame.RMSECV_X <= limit].min() == frame.components[frame.recommended].iloc[0]
    assert (frame.CumulativeExplainedVariance_X.diff().dropna() >= -1e-12).all()


def test_sd_rule_is_never_less_parsimonious(low_rank):
    _, _, s = low_rank
    assert pca.pca_cv(s, CENTER, 8, 4, rule="one_sd")[1] <= pca.pca_cv(s, CENTER, 8, 4)[1]


def test_imputation_and_scaling_are_refitted_per_fold(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 6)) * np.arange(1, 7)
    gaps = x.copy()
    gaps[3, 2] = gaps[11, 5] = np.nan
    s = spectra_of(spark, gaps, np.arange(6.0))
    frame, _ = pca.pca_cv(s, [Step("Autoscale")], 3, 4)
    fold_of = by_id(pca.assign_folds(s, 4, 20)[0].df.select("sample_index", "fold")).fold.to_numpy()

    def prepare(a, b):
        med = np.nanmedian(a, axis=0)
        a, b = (np.where(np.isnan(m), med, m) for m in (a, b))
        return (a - a.mean(0)) / a.std(0), (b - a.mean(0)) / a.std(0)

    rmse, press, q2 = brute_cv(gaps, fold_of, 3, prepare)
    assert np.allclose(frame.RMSECV_X, rmse, rtol=1e-7) and np.allclose(frame.Q2_X, q2, rtol=1e-7)
    assert frame.ExplainedVariance_X.notna().all()


def test_small_inputs(spark):
    s = spectra_of(spark, np.random.default_rng(0).normal(size=(6, 9)), np.arange(9.0))
    frame, best = pca.pca_cv(s, CENTER, 5, 3)
    assert np.isfinite(frame.RMSECV_X).all() and best >= 1
    with pytest.raises(ValueError):
        pca.pca_cv(s.filter("sample_index < 3"), CENTER)
    with pytest.raises(ValueError, match="two independent groups"):
        pca.pca_cv(spectra_of(spark, np.eye(5), np.arange(5.0), pd.DataFrame({"g": ["a"] * 5})), CENTER, group="g")


def test_contributions_add_up(low_rank):
    x, axis, s = low_rank
    model = pca.fit_pca(s, CENTER, 3)
    row = by_id(pca.diagnostics(model, s).table).loc[5]
    c = pca.sample_contributions(model, s, 5).toPandas()
    assert len(c) == 50 and c.Q_contribution.sum() == pytest.approx(row.Q_residual)
    assert c.Q_scaled.max() == pytest.approx(1) and np.allclose(c.T2_signed_direction**2, c.T2_related_contribution)
    # squared signed directions sum to T2 because loadings are orthonormal
    assert c.T2_related_contribution.sum() == pytest.approx(row.Hotelling_T2)
    with pytest.raises(IndexError):
        pca.sample_contributions(model, s, 99)


def test_regions_are_on_axis_and_merge_neighbours(spark):
    axis = np.arange(0.0, 100.0)
    v = np.zeros(100)
    v[[10, 11, 13, 40, 41, 80]] = [5, 6, 4, -7, -3, 2]
    df = spark.createDataFrame([(1, float(w), float(a)) for w, a in zip(axis, v)], "PC int, wn double, loading double")
    got = regions.high_regions(df, "PC", "loading", axis, quantile=0.95).orderBy("region_min").toPandas()
    assert list(zip(got.region_min, got.region_max, got.peak, got.direction)) == [
        (10.0, 13.0, 11.0, "positive"), (40.0, 41.0, 40.0, "negative"),
    ]
    assert len(regions.high_regions(df, "PC", "loading", axis, quantile=0.95, top=1).collect()) == 1


def test_moments_split_into_scans_by_memory(spark):
    from pyspark.sql import functions as F

    from spectraloom.operators.moments import accumulate
    from spectraloom.operators.pca import stateless

    rng = np.random.default_rng(8)
    s = spectra_of(spark, rng.normal(size=(60, 12)), np.arange(12.0))
    chains = [stateless(s.axis, []), stateless(s.axis, [])]
    pivots = [np.zeros(12), np.ones(12)]
    df = s.df.withColumn("key", (F.col("sample_index") % 5).cast("int"))
    df = df.withColumn("keys", F.array(F.col("key"), F.lit(7)))
    for key in (None, "key", "keys"):
        whole = accumulate(df, chains, pivots, key=key)
        split = accumulate(df, chains, pivots, key=key, budget=3 * 8 * 13 * 13)
        assert whole.keys() == split.keys() and len(whole) == 2 * {None: 1, "key": 5, "keys": 6}[key]
        assert all(np.allclose(whole[k].gram, split[k].gram) and whole[k].n == split[k].n for k in whole)
