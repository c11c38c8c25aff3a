import glob
import json
import os

import numpy as np
import pandas as pd
import pytest

from conftest import spectra_of
from spectraloom.operators import qc
from spectraloom.operators.recipe import Step
from spectraloom.plans import audit, guided, health, nested, selection
from spectraloom.operators.metadata import infer_schema


def summary_row(name, q2, sep, snv, steps):
    return {
        "name": name, "components": 2, "Q2_X": q2, "RMSECV_X": 1 - q2 if np.isfinite(q2) else 0.5,
        "group_separation": sep, "uses_snv": snv, "complexity": steps,
    }


NAN = float("nan")


@pytest.mark.parametrize(
    "rows,label,expected,guard",
    [
        # reconstruction only: SNV gain below 0.03 is rejected
        ([("raw", 0.80, NAN, False, 0), ("snv", 0.82, NAN, True, 1)], None, "raw", True),
        ([("raw", 0.70, NAN, False, 0), ("snv", 0.82, NAN, True, 1)], None, "snv", False),
        # separation decides inside the Q2 tolerance
        ([("raw", 0.80, 0.2, False, 0), ("d1", 0.75, 0.5, False, 1), ("d2", 0.60, 0.9, False, 1)], "L", "d1", False),
        # useless separation falls back to reconstruction
        ([("raw", 0.80, 0.05, False, 0), ("d1", 0.75, 0.08, False, 1)], "L", "raw", False),
        # SNV must beat plain separation by 0.05
        ([("raw", 0.80, 0.40, False, 0), ("snv", 0.80, 0.44, True, 1)], "L", "raw", True),
        # near tie: simpler recipe wins
        ([("raw", 0.79, NAN, False, 0), ("d1", 0.80, NAN, False, 1)], None, "raw", False),
        # nothing finite: lowest error
        ([("a", NAN, NAN, False, 1), ("b", NAN, NAN, False, 0)], None, "b", False),
    ],
)
def test_recommendation_rules(rows, label, expected, guard):
    frame = pd.DataFrame([summary_row(*r) for r in rows])
    chosen, decision = selection.choose_recommendation(frame, label)
    assert chosen["name"] == expected == decision["selected_name"]
    assert decision["snv_guard_applied"] == guard and len(decision["rules"]) == 4
    with pytest.raises(ValueError):
        selection.choose_recommendation(frame.iloc[:0], label)


def test_snv_is_rejected_when_it_erases_amplitude(spark, amplitude_set):
    meta, axis, x = amplitude_set
    entries, summary, decision = selection.compare_recipes(spectra_of(spark, x, axis, meta))
    assert len(summary) == 10 and not entries[0]["uses_snv"] and decision["label_column"] == "Brand"
    assert {"name", "components", "Q2_X", "RMSECV_X", "PC1_PC2_percent", "group_separation", "uses_snv",
            "complexity", "recipe", "objective", "recommendation"} <= set(summary.columns)
    assert summary.recommendation[0] == "DEFAULT" and summary.objective.sum() == 1
    with_snv = summary[summary.uses_snv.astype(bool)].group_separation.max()
    assert summary[~summary.uses_snv.astype(bool)].group_separation.max() > with_snv + 0.05
    with pytest.raises(ValueError, match="At least 6"):
        selection.compare_recipes(spectra_of(spark, x[:5], axis, meta[:5]))


def test_flat_spectrum_is_flagged_not_removed(spark, confounded_set):
    meta, axis, x = confounded_set
    x = x.copy()
    x[5] = 1.0
    s = spectra_of(spark, x, axis, meta)
    result = audit.spectral_qc(s, infer_schema(s.df, s.meta))
    table = result.table.toPandas().sort_values("sample_index", ignore_index=True)
    assert len(table) == 24 and table.flat_flag[5] and table.qc_review[5] and not table.possible_saturation_flag[5]
    assert table.near_extreme_fraction[5] == 1.0 and set(qc.FLAGS) <= set(table.columns)
    assert result.replicates is not None and result.replicates.count() == 8


def test_guided_analysis_end_to_end(spark, base_set, tmp_path):
    meta, axis, x = base_set
    result = guided.guided_analysis(spectra_of(spark, x, axis, meta), "500-600", restarts=4, resamples=3)
    assert result.label == "manufacturer_name" and result.groups == ["station_code", "City"]
    assert result.exclusion.normalized == "500-600" and not ((result.model.axis >= 500) & (result.model.axis <= 600)).any()
    assert result.diagnostics.table.count() == 24 == result.clustering.labels.count()
    heads = [*audit.HEADINGS, "DETAILED GUIDED-SELECTION AUDIT", "RECOMMENDED DEFAULT", "WHY THIS WAS CHOSEN",
             "AUTOMATIC DECISION RULES", "WHAT ELSE WAS FOUND", "HARD SPECTRAL EXCLUSION"]
    at = [result.report.index(h) for h in heads]
    assert at == sorted(at)
    regions = result.audit.regions.toPandas()
    assert regions.peak.between(axis.min(), axis.max()).all()
    brand = result.audit.associations.set_index("metadata").pca_association["manufacturer_name"]
    assert brand > 0.05 and 0 <= result.audit.health["score"] <= 100
    guided.export(result, str(tmp_path))
    names = set(os.listdir(tmp_path))
    assert {
        "preprocessing_comparison.csv", "pca_cross_validation.csv", "pca_scores.csv", "pca_loadings.csv",
        "pca_outlier_diagnostics.csv", "clustering_metrics.csv", "cluster_assignments.csv", "analysis_manifest.json",
        "analysis_summary.txt", "spectral_qc.csv", "preprocessing_stability.csv", "pca_resampling_stability.csv",
        "pca_loading_regions.csv", "metadata_associations.csv", "metadata_confounds.csv",
        "independent_group_support.csv", "model_health_subscores.csv", "smart_analysis_report.txt", "model_health.json",
    } <= names
    manifest = "".join(open(f).read() for f in glob.glob(str(tmp_path / "analysis_manifest.json" / "part-*")))
    assert json.loads(manifest)["hard_exclusion"] == "500-600"
    row = guided.inspect_sample(result, 3).first()
    assert row["specimen_id"] == "A-1-0" and row["PC1"] is not None


def test_health_steps():
    h = health.model_health(0.92, 0.02, 0.9, 0.8, 1.2, [0.65], 4)
    assert h["subscores"].score.tolist() == [95, 100, 90, 80, 100, 65, 80] and h["band"] == "GREEN"
    h = health.model_health(NAN, 0.5, NAN, NAN, NAN, [], NAN)
    assert h["subscores"].component.tolist() == ["Data QC", "Metadata confounding"] and h["score"] == 57.5
    p = health.predictive_subscores(0.8, 2, [0.78, 0.82], 0.05)
    assert p.score.tolist() == [60, 100, 90] and p.score.between(0, 100).all()
    both = health.combine_health(h, p)
    assert len(both["subscores"]) == 5 and both["band"] in {"GREEN", "YELLOW", "RED"}


@pytest.fixture(scope="module")
def two_class(spark):
    rng = np.random.default_rng(4)
    label = np.repeat(["A", "B"], 16)
    x = rng.normal(0, 0.2, (32, 6)) + np.outer(label == "B", [1, 0.6, 0.2, 0, 0, 0])
    meta = pd.DataFrame({"label": label, "site": [f"s{i % 8}" for i in range(32)]})
    return spectra_of(spark, x, np.arange(6.0), meta)


def test_nested_validation_has_no_leak(spark, two_class, tmp_path):
    from pyspark.sql import functions as F

    r = nested.nested_audit(two_class, "label", F.col("site"), [Step("Mean center")], trials=3, outer_folds=2, trees=(10, 20))
    oof = r.oof.toPandas()
    assert sorted(oof.sample_index) == list(range(32)) and set(oof.outer_fold) == {1, 2}
    assert oof.groupby("group").outer_fold.nunique().eq(1).all()
    splits = r.splits.toPandas()
    for _, part in splits.groupby("outer_fold"):
        train, test = (set(part[part.role == k].group) for k in ("train", "test"))
        assert not train & test
    assert r.balanced_accuracy > 0.8 and set(r.family_folds.model) == {"SVM", "Random Forest", "PLS-DA"}
    assert (r.family_folds.groupby("fold").model.nunique() == 3).all() and r.family_oof.count() == 96
    assert (r.history.status == "complete").all() and r.history.recipe_name.iloc[0] == "Current expert recipe"
    assert r.history.outer_balanced_accuracy.notna().all() and len(r.folds.columns) == 18
    nested.export(r, spark, str(tmp_path))
    assert {"out_of_fold_predictions.csv", "validation_split_audit.csv", "optimization_history.csv"} <= set(os.listdir(tmp_path))
    steps, params = r.history.recipe.iloc[0], r.history.model.iloc[0]
    assert json.loads(steps) and params == "SVM"


def test_exploratory_mode_and_grouped_refusal(spark, two_class):
    from pyspark.sql import functions as F

    r = nested.nested_audit(two_class, "label", mode="exploratory", trials=1, outer_folds=2, trees=(5,))
    assert r.summary.startswith("EXPLORATORY") and r.oof.toPandas().group.nunique() == 32
    one_source = F.when(F.col("label") == "A", "station_a").otherwise("station_b")
    with pytest.raises(ValueError, match="independent groups"):
        nested.nested_audit(two_class, "label", one_source, trials=1, outer_folds=2)
    with pytest.raises(ValueError):
        nested.nested_audit(two_class, "label", mode="other")


def test_permuted_labels_keep_their_counts(two_class):
    shuffled = nested.permute_labels(two_class, "label", 5).df.toPandas().sort_values("sample_index")
    assert shuffled.label.value_counts().to_dict() == {"A": 16, "B": 16}
    assert (shuffled.label.to_numpy() != np.repeat(["A", "B"], 16)).any() and len(shuffled) == 32
