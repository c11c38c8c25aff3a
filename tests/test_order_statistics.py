import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectraloom.operators.quantiles import exact_quantiles
from spectraloom.operators import folds, ranks
from spectraloom.operators.ranks import average_rank

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, and a few are enormous."""
    rng = np.random.default_rng(5)
    v = np.concatenate([np.full(1000, 2.5), rng.normal(0, 1, 1500), rng.pareto(0.5, 500) * 1e6])
    k = np.where(np.arange(3000) % 5 == 0, "a", "b")
    frame = pd.DataFrame({"id": np.arange(3000), "k": k, "v": v})
    return frame, spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("bound", [10**6, 20, 1])
def test_exact_quantiles_by_gathering_or_refining(skewed, bound):
    frame, df = skewed
    got = exact_quantiles(df, "v", PROBS, gather_bound=bound)[()]
    assert np.allclose(got, np.quantile(frame.v, PROBS), rtol=1e-14)
    keyed = exact_quantiles(df, "v", PROBS, ["k"], gather_bound=bound)
    for k, part in frame.groupby("k"):
        assert np.allclose(keyed[(k,)], np.quantile(part.v, PROBS), rtol=1e-14)


def test_quantiles_ignore_gaps(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert exact_quantiles(df, "v", [0.5])[()] == [2.0]
    assert exact_quantiles(df.filter("v > 10"), "v", [0.5]) == {}


@pytest.mark.parametrize("bucket_rows", [10**6, 100])
def test_average_rank_is_global_with_ties(skewed, bucket_rows):
    frame, df = skewed
    got = average_rank(df, "v", "r", bucket_rows).toPandas().sort_values("id")
    assert np.array_equal(got.r.to_numpy(), frame.v.rank().to_numpy())


@pytest.mark.parametrize("bucket_rows", [10**6, 50])
@pytest.mark.parametrize("within", [None, "k"])
def test_hash_cuts_split_exactly(skewed, bucket_rows, within):
    _, df = skewed
    salts = ["1", "2"]
    cuts = ranks.hash_cuts(df, "id", salts, ranks.even_splits(7), within, bucket_rows)
    seen = []
    for salt in salts:
        for g in ("a", "b") if within else (None,):
            part = df.filter(F.col("k") == g) if g else df
            got = part.select("id", ranks.cut_index("id", salt, cuts[(salt, g)]).alias("f")).toPandas()
            sizes = got.f.value_counts()
            assert sorted(sizes.index) == list(range(7)) and sizes.max() - sizes.min() <= 1
            seen.append(tuple(got.sort_values("id").f))
    assert len(set(seen)) == len(seen)


def test_row_folds(spark, skewed):
    _, df = skewed
    got = folds.stratified_row_folds(df, "id", "k", 4, 42).toPandas()
    assert (got.groupby("k").fold.value_counts().unstack().T.max() - got.groupby("k").fold.value_counts().unstack().T.min()).max() <= 1
    few = folds.row_folds(spark.range(5).withColumnRenamed("id", "i"), "i", 3, 1).toPandas()
    assert sorted(few.fold.value_counts()) == [1, 2, 2]


@pytest.mark.parametrize("bucket_rows,broadcast_values", [(200_000, 500_000), (7, 500_000), (7, 0)])
def test_ranks_of_big_keys_nulls_and_nan(spark, bucket_rows, broadcast_values):
    keys = [2**53 + i for i in range(40)] + [2**53 + 3, None, None, -5]
    df = spark.createDataFrame([(k,) for k in keys], "v bigint").repartition(3)
    got = average_rank(df, "v", "r", bucket_rows, broadcast_values=broadcast_values).toPandas()
    want = pd.Series([k for k in keys if k is not None]).rank()
    assert len(got) == len(keys) and got.r.isna().sum() == 2
    assert sorted(got.r.dropna()) == sorted(want)
    floats = [1.5, float("nan"), -float("inf"), float("inf"), 1.5, float("nan"), 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in floats], "v double")
    got = average_rank(df, "v", "r", 2, broadcast_values=broadcast_values).toPandas()
    assert sorted(got.r) == [1.0, 2.5, 2.5, 4.5, 4.5, 6.0, 7.5, 7.5]


def test_quantiles_ignore_what_is_not_finite(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=500), [np.inf, -np.inf, np.nan, 1e308, -1e308, 5e-324, -5e-324]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    small, large = (exact_quantiles(df, "v", probs, gather_bound=b)[()] for b in (20_000, 10))
    finite = v[np.isfinite(v)]
    assert small == large and small[0] == -1e308 and small[-1] == 1e308
    assert np.allclose(small[1:4], np.quantile(finite, probs[1:4]))
