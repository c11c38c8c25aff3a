import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import spectra_of
from spectraloom.operators import association, folds, metadata, metrics
from spectraloom.operators.metadata import header_score


@pytest.fixture(scope="module")
def base(spark, base_set):
    meta, axis, x = base_set
    s = spectra_of(spark, x, axis, meta)
    return s, metadata.infer_schema(s.df, s.meta)


def test_roles_and_suggestions(base):
    _, schema = base
    assert schema.roles() == {
        "specimen_id": "sample_id", "manufacturer_name": "brand_or_manufacturer", "station_code": "site_or_station",
        "City": "city", "State": "state_or_province", "collection_year": "year",
    }
    assert metadata.suggest_label(schema) == "manufacturer_name" == metadata.trusted_label(schema)
    assert metadata.suggest_groups(schema) == ["station_code", "City"]
    table = schema.table.set_index("column")
    assert table.unique_values["City"] == 4 and table.missing_percent["City"] == 0
    assert table.example["State"] == "CA, CA, CA" and table.reason["State"] == "column name + value pattern"
    changed = schema.override("City", "region")
    assert changed.roles()["City"] == "region" and changed.table.set_index("column").confidence["City"] == 1.0


def test_value_evidence(spark):
    df = spark.createDataFrame(
        [(i, f"v{i}", f"20{i:02d}-01-0{i % 9 + 1}", 1990 + i, "ab c"[i % 3 :][:2], None) for i in range(12)],
        "sample_index bigint, a string, b string, c bigint, d string, e string",
    )
    roles = metadata.infer_schema(df, ["a", "b", "c", "e"]).table.set_index("column")
    assert roles.role["a"] == "sample_id" and roles.role["b"] == "date" and roles.role["c"] == "year"
    assert roles.role["e"] == "other" and roles.missing_percent["e"] == 100
    assert header_score("capacity", "city") == 0.78 and header_score("Sample ID", "sample_id") == 0.92


def test_groups_and_eligibility(base):
    s, _ = base
    keyed = s.df.select(metadata.group_key(s.df, ["manufacturer_name", "station_code"]).alias("g")).distinct().count()
    assert keyed == 8
    with pytest.raises(ValueError, match="Grouping columns not found: nope"):
        metadata.group_key(s.df, ["nope"])
    got = metadata.eligibility(s.df, "manufacturer_name", ["station_code"], 4).toPandas()
    assert got.eligible.all() and (got.independent_groups == 4).all()
    assert not metadata.eligibility(s.df, "manufacturer_name", ["station_code"], 5).toPandas().eligible.any()
    some = spark_labels(s.df)
    kept = metadata.eligible_rows(some, "l", metadata.exploratory_eligibility(some, "l", 2))
    assert {r.l for r in kept.select("l").distinct().collect()} == {"big"}


def spark_labels(df):
    i = F.col("sample_index")
    return df.withColumn("l", F.when(i < 2, "tiny").when(i < 5, F.lit(None)).otherwise("big"))


def test_confounds(spark, confounded_set):
    meta, axis, x = confounded_set
    s = spectra_of(spark, x, axis, meta)
    table, warnings = association.confounds(s.df, s.meta, "Brand")
    row = table[(table.metadata_a == "Brand") & (table.metadata_b == "City")].iloc[0]
    assert row.cramers_v > 0.95 and row.level == "strong" and row.p_value < 1e-3 and warnings
    rep = table[(table.metadata_a == "Brand") & (table.metadata_b == "Replicate")].iloc[0]
    assert rep.cramers_v == pytest.approx(0, abs=1e-9) and rep.p_value == pytest.approx(1)


def brute_eta(v, g):
    whole = ((v - v.mean()) ** 2).sum()
    return sum((g == c).sum() * (v[g == c].mean() - v.mean()) ** 2 for c in set(g)) / whole


@pytest.mark.parametrize("rows_per_bucket", [10**9, 10])
def test_permuted_effects_are_exact_permutations(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    n = 240
    g = np.array(["a"] * 100 + ["b"] * 90 + ["c"] * 50)
    v = rng.normal(size=n) + (g == "a")
    df = spark.createDataFrame(
        [(i, str(c), None if i % 7 == 0 else str(c), float(x)) for i, (c, x) in enumerate(zip(g, v))],
        "sample_index bigint, g string, h string, v double",
    ).repartition(3)
    null = association.permuted_effects(df, ["g", "h"], ["v"], 40, 1, rows_per_bucket)
    fine = association.permuted_effects(df, ["g", "h"], ["v"], 40, 1, 30)
    assert len(null["g"]) == 40 and (null["g"] < brute_eta(v, g)).all()
    # the expected eta squared under permutation is (levels - 1) / (n - 1)
    for c, m in (("g", n), ("h", n - len(range(0, n, 7)))):
        for found in (null[c], fine[c]):
            assert found.mean() == pytest.approx(2 / (m - 1), rel=0.6) and found.max() < 0.08


def test_associations_rank_the_real_driver(spark):
    rng = np.random.default_rng(0)
    n = 60
    brand = np.where(np.arange(n) % 2 == 0, "x", "y")
    score = rng.normal(size=(n, 3))
    score[:, 0] += 4 * (brand == "x")
    rows = [
        (i, str(brand[i]), str(i % 5), float(score[i, 1] * 2 + 0.01 * rng.normal()), None, [float(v) for v in score[i]], int(i % 2))
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "sample_index bigint, brand string, other string, amount double, gone string, scores array<double>, cl int"
    )
    t = association.metadata_associations(df, ["brand", "other", "amount", "gone"], 3, "cl").set_index("metadata")
    assert set(t.index) == {"brand", "other", "amount"}
    assert t.type["amount"] == "numeric" and t.pca_association["amount"] > 0.95 and t.pca_p_value["amount"] < 1e-6
    assert t.pca_p_value["brand"] == pytest.approx(0.02) and t.cluster_cramers_v["brand"] == pytest.approx(1)
    assert t.pca_association["brand"] == pytest.approx(max(brute_eta(score[:, j], brand) for j in range(3)))
    assert t.pca_p_value["other"] > 0.05 and t.strength["brand"] == "strong"


def test_group_folds_are_disjoint_and_balanced(spark):
    rows = [(f"g{i}", "ab"[i % 2], 1 + (i == 0) * 500) for i in range(40)]
    dealt = folds.group_folds(spark.createDataFrame(rows, "`group` string, label string, rows bigint"), 4, 42).toPandas()
    assert len(dealt) == 40 and dealt.groupby(["stratum", "fold"]).size().eq(5).all()
    again = folds.group_folds(spark.createDataFrame(rows[::-1], "`group` string, label string, rows bigint"), 4, 42).toPandas()
    assert dealt.set_index("group").fold.to_dict() == again.set_index("group").fold.to_dict()
    leaking = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "g string, fold int")
    assert [r.g for r in folds.leakage(leaking, "g").collect()] == ["a"]


def test_classification_measures(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    row = metrics.summary_scores(metrics.confusion(df, "t", "p")).first()
    assert row.balanced_accuracy == pytest.approx(0.5) and row.macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    per = metrics.per_class(metrics.confusion(df, "t", "p")).toPandas().set_index("class")
    assert per.specificity["b"] == pytest.approx(1 / 3) and per.sensitivity_recall["c"] == 0


def test_eta_squared_with_a_large_offset(spark):
    rng = np.random.default_rng(3)
    g = np.repeat(["a", "b"], 50)
    v = 1e9 + (g == "b") + rng.normal(0, 0.02, 100)
    df = spark.createDataFrame([(i, str(a), float(x)) for i, (a, x) in enumerate(zip(g, v))], "sample_index bigint, g string, v double")
    x = v - 1e9
    want = 50 * sum((x[g == c].mean() - x.mean()) ** 2 for c in "ab") / ((x - x.mean()) ** 2).sum()
    assert association.eta_squared(df, ["g"], ["v"]).first()["eta_squared"] == pytest.approx(want, abs=1e-6) and want > 0.99
    null = association.permuted_effects(df, ["g"], ["v"], 30, 1)["g"]
    assert 0 < null.max() < 0.5
    flat = df.withColumn("v", F.lit(7.5))
    assert association.eta_squared(flat, ["g"], ["v"]).first()["eta_squared"] == 0.0
