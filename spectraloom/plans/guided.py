"""Guided unsupervised analysis: one call from spectra to an audited result bundle."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import ExclusionInfo
from ..operators import clustering as clusters
from ..operators.metadata import MetadataSchema, infer_schema, suggest_groups, suggest_label
from ..operators.pca import Diagnostics, PcaModel, diagnostics
from ..session import durable
from ..sources import sinks
from ..spectra import ID, Spectra
from .audit import Audit, comprehensive
from .selection import compare_recipes, snv_summary

MAX_CLUSTER_PCS = 10


@dataclass(frozen=True)
class Guided:
    spectra: Spectra
    exclusion: ExclusionInfo | None
    schema: MetadataSchema
    label: str | None
    groups: list[str]
    comparisons: list[dict]
    summary: pd.DataFrame
    decision: dict
    model: PcaModel
    scores: DataFrame
    diagnostics: Diagnostics
    clustering: clusters.ClusterBenchmark
    audit: Audit | None
    report: str

    @property
    def selected(self) -> dict:
        return self.comparisons[0]


def guided_analysis(
    spectra: Spectra,
    exclusion: str = "",
    max_components: int = 20,
    audit: bool = True,
    restarts: int = clusters.BENCHMARK_RESTARTS,
    resamples: int = 8,
    rule: str = "one_se",
) -> Guided:
    """Hard exclusion, roles, recipe comparison, PCA, diagnostics, clustering and audit."""
    info = None
    if exclusion:
        spectra, info = spectra.exclude(exclusion)
    profile = spectra.profile()
    schema = infer_schema(spectra.df, spectra.meta)
    label, groups = suggest_label(schema), suggest_groups(schema)
    comparisons, summary, decision = compare_recipes(spectra, schema, max_components, rule=rule, profile=profile)
    selected = comparisons[0]
    model: PcaModel = selected["model"]
    flags = diagnostics(model, spectra)
    # components x samples: reused by clustering, associations and stability
    scores = durable(model.scores(spectra))
    used = max(2, min(selected["best_components"], model.components, MAX_CLUSTER_PCS))
    plane = scores.select(ID, F.slice("scores", 1, used).alias("z"))
    benchmark = clusters.analyze(plane, "z", profile.n, restarts=restarts)
    checked = (
        comprehensive(
            spectra, schema, label, groups, comparisons, model, flags, benchmark, scores, profile, resamples
        )
        if audit
        else None
    )
    flagged = flags.table.filter("review_flag").count()
    text = _report(selected, decision, summary, label, groups, flagged, profile.n, benchmark, info, spectra.width)
    report = f"{checked.report}\n\nDETAILED GUIDED-SELECTION AUDIT\n{text}" if checked else text
    return Guided(
        spectra, info, schema, label, groups, comparisons, summary, decision, model, scores, flags, benchmark,
        checked, report,
    )


def _report(selected, decision, summary, label, groups, flagged, n, benchmark, info, width) -> str:
    why = (
        f"Chosen by {decision['selection_mode']}; the best reconstruction is {decision['best_general_name']} "
        f"(Q²-X {decision['best_general_q2']:.3f}). {decision['snv_guard_message']}"
    )
    found = (
        f"{snv_summary(summary, decision['label_column'])} {flagged} of {n} sample(s) are flagged for review. "
        f"{benchmark.report} Label suggestion: {label or 'none'}; grouping suggestion: {', '.join(groups) or 'none'}."
    )
    excluded = info.describe() if info else f"No hard spectral exclusion; all {width} variables are used."
    sections = {
        "RECOMMENDED DEFAULT": f"{selected['name']} with {selected['best_components']} component(s), Q²-X {selected['Q2_X']:.3f}.",
        "WHY THIS WAS CHOSEN": why,
        "AUTOMATIC DECISION RULES": "\n".join(f"- {r}" for r in decision["rules"]),
        "WHAT ELSE WAS FOUND": found,
        "HARD SPECTRAL EXCLUSION": excluded,
    }
    return "\n\n".join(f"{h}\n{t}" for h, t in sections.items())


def export(result: Guided, folder: str) -> None:
    """Write every table, the manifest and the report of a guided analysis."""
    spark, model = result.spectra.spark, result.model
    tables = {
        "preprocessing_comparison.csv": result.summary,
        "pca_cross_validation.csv": result.selected["cv"],
        "pca_scores.csv": sinks.wide_scores(result.scores, model.components, result.spectra.meta),
        "pca_loadings.csv": _wide_loadings(model),
        "pca_outlier_diagnostics.csv": result.spectra.metadata().join(result.diagnostics.table, ID),
        "clustering_metrics.csv": result.clustering.table,
        "cluster_assignments.csv": result.clustering.labels,
        "metadata_schema.csv": result.schema.table,
    }
    if result.audit:
        a = result.audit
        tables |= {
            "spectral_qc.csv": a.qc.table,
            "replicate_consistency.csv": a.qc.replicates,
            "preprocessing_stability.csv": a.preprocessing.table,
            "pca_resampling_stability.csv": a.loadings.table,
            "pca_loading_regions.csv": a.regions,
            "metadata_associations.csv": a.associations,
            "metadata_confounds.csv": a.confounds,
            "independent_group_support.csv": a.support,
            "model_health_subscores.csv": a.health["subscores"],
        }
        sinks.write_text(spark, a.report, f"{folder}/smart_analysis_report.txt")
        sinks.write_json(
            spark, {k: v for k, v in a.health.items() if k != "subscores"}, f"{folder}/model_health.json"
        )
    for name, table in tables.items():
        sinks.write_table(spark, table, f"{folder}/{name}")
    manifest = {
        "selected_preprocessing": result.selected["name"],
        "selected_pca_components": result.selected["best_components"],
        "selected_recipe": [asdict(s) for s in result.selected["steps"]],
        "hard_exclusion": result.exclusion.normalized if result.exclusion else "",
        "suggested_label": result.label,
        "suggested_groups": result.groups,
        "analysis_claim": "Exploratory PCA/clustering results are not predictive validation.",
    }
    sinks.write_json(spark, manifest, f"{folder}/analysis_manifest.json")
    sinks.write_text(spark, result.report, f"{folder}/analysis_summary.txt")


def _wide_loadings(model: PcaModel) -> pd.DataFrame:
    frame = pd.DataFrame(model.loadings, columns=[f"PC{i + 1}_loading" for i in range(model.components)])
    frame.insert(0, "wavenumber_cm-1", model.axis)
    return frame


def inspect_sample(result: Guided, sample_index: int) -> DataFrame:
    """Metadata, first five scores, diagnostics and cluster of one sample."""
    point = F.col(ID) == int(sample_index)
    return (
        sinks.wide_scores(result.scores.filter(point), min(5, result.model.components), result.spectra.meta)
        .join(result.diagnostics.table.filter(point), ID)
        .join(result.clustering.labels.filter(point), ID)
    )
