"""The comprehensive audit: QC, stability, drivers, associations, confounds, support, health."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association, metadata, qc
from ..operators.clustering import ClusterBenchmark, Stability, cluster_stability
from ..operators.metadata import MetadataSchema
from ..operators.pca import Diagnostics, PcaModel
from ..operators.recipe import median_fill
from ..operators.regions import loading_regions
from ..operators.stability import preprocessing_stability, resampling_stability
from ..spectra import ID, Profile, Spectra
from . import health as health_rules

# Wording limits and report headings.
SMALL_GAIN, MODEST_GAIN = 0.01, 0.03
DISTANCE_DOMINANCE = 2.0
HEADINGS = (
    "MODEL HEALTH", "DATA QUALITY", "PCA VALIDATION", "STABILITY", "SPECTRAL DRIVERS",
    "METADATA / CONFOUNDING", "INTERPRETATION BOUNDARY", "HEALTH SCORE NOTE",
)
QC_TEXTS = {
    "flat_flag": "are flat or nearly constant",
    "extreme_intensity_flag": "have unusually extreme intensity",
    "high_noise_flag": "have unusually high high-frequency noise",
    "possible_saturation_flag": "show a possible saturation plateau",
    "high_baseline_flag": "have an unusually large baseline slope",
}


@dataclass(frozen=True)
class QcResult:
    table: DataFrame
    replicates: DataFrame | None
    flagged_share: float
    summary: str


@dataclass(frozen=True)
class Audit:
    qc: QcResult
    preprocessing: Stability
    loadings: Stability
    component_choices: list[int]
    clusters: Stability
    regions: DataFrame
    associations: pd.DataFrame
    confounds: pd.DataFrame
    warnings: list[str]
    support: pd.DataFrame
    health: dict
    report: str


def spectral_qc(spectra: Spectra, schema: MetadataSchema | None = None, profile: Profile | None = None) -> QcResult:
    """Sample flags plus replicate consistency when the metadata says what is replicated."""
    profile = profile or spectra.profile()
    table = qc.qc_table(spectra, profile.incomplete)
    counts = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("qc_review").alias("review"),
        F.count_if(F.col("missing_fraction") > 0).alias("gaps"),
        *[F.count_if(f).alias(f) for f in qc.FLAGS],
    ).first()
    parts = [f"{counts['gaps']} sample(s) contain missing values."] if counts["gaps"] else []
    parts += [f"{counts[f]} sample(s) {text}." for f, text in QC_TEXTS.items() if counts[f]]
    if not parts:
        parts = ["No sample-level warning at the current thresholds."]
    replicates = None
    replicate, context = qc.replicate_columns(schema.roles()) if schema else ([], [])
    if not replicate:
        parts.append("No replicate column was detected.")
    elif not context:
        parts.append(f"Replicate column '{replicate[0]}' found, but no column says what is replicated.")
    else:
        fill = median_fill(spectra) if profile.incomplete else None
        replicates = qc.replicate_consistency(spectra, metadata.group_key(spectra.df, context), fill)
        seen = replicates.agg(F.count(F.lit(1)).alias("n"), F.count_if("warning").alias("w")).first()
        if not seen["n"]:
            parts.append("No replicate group holds more than one spectrum.")
        elif seen["w"]:
            parts.append(f"{seen['w']} replicate group(s) fall below correlation {qc.REPLICATE_CORRELATION:.2f}.")
        else:
            parts.append("Replicate groups are consistent.")
    share = counts["review"] / counts["n"] if counts["n"] else math.nan
    return QcResult(table, replicates, share, " ".join(parts))


def component_narrative(cv: pd.DataFrame, best: int) -> str:
    """How much the held-out error would still fall beyond the chosen count."""
    chosen = float(cv.loc[cv.components == best, "RMSECV_X"].iloc[0])
    later = cv.loc[cv.components > best, "RMSECV_X"]
    if later.empty or chosen <= 0:
        return f"{best} component(s) are the most the validation could test."
    gain = (chosen - float(later.min())) / chosen
    if gain < SMALL_GAIN:
        return f"Beyond {best} component(s) the held-out error falls by less than 1%."
    if gain < MODEST_GAIN:
        return f"Beyond {best} component(s) the held-out error falls by less than 3%."
    return f"More than {best} component(s) could cut the held-out error by {100 * gain:.1f}%; the simpler model was kept by rule."


def comprehensive(
    spectra: Spectra,
    schema: MetadataSchema,
    label: str | None,
    groups: Sequence[str],
    comparisons: Sequence[dict],
    model: PcaModel,
    diagnostics: Diagnostics,
    clustering: ClusterBenchmark,
    scored: DataFrame,
    profile: Profile,
    resamples: int = 8,
    seed: int = 42,
) -> Audit:
    """Everything the guided result needs before anyone interprets it."""
    selected = comparisons[0]
    quality = spectral_qc(spectra, schema, profile)
    prep = preprocessing_stability(spectra, comparisons, profile.n)
    loads, choices = resampling_stability(spectra, selected["steps"], model, profile, resamples, 4, seed)
    stable = cluster_stability(scored, "scores", model.components, clustering, profile.n, resamples, seed)
    regions = loading_regions(model, spectra.spark)
    tagged = scored.join(clustering.labels.withColumnRenamed("cluster", "_cluster"), ID)
    links = association.metadata_associations(tagged, list(spectra.meta), model.components, "_cluster", seed=seed)
    pairs, warnings = association.confounds(spectra.df, list(spectra.meta), label)
    support, smallest = pd.DataFrame(), math.nan
    if label and groups:
        support = metadata.group_support(spectra.df, label, groups).orderBy("class").toPandas()
        smallest = float(support.independent_groups.min()) if len(support) else math.nan
    worst_t2 = diagnostics.table.agg(F.max("Hotelling_T2").alias("m")).first()["m"]
    scores = health_rules.model_health(
        selected["Q2_X"], quality.flagged_share, prep.score, loads.score, stable.score,
        list(pairs.cramers_v), smallest,
    )
    dominance = worst_t2 / diagnostics.t2_limit if diagnostics.t2_limit else math.nan
    sections = [
        "; ".join(f"{r.component}: {r.score:.0f} ({r.reason})" for r in scores["subscores"].itertuples())
        + f". Overall {scores['score']:.0f} - {scores['band']}.",
        quality.summary,
        f"Q²-X {selected['Q2_X']:.3f} with {selected['best_components']} component(s). "
        + component_narrative(selected["cv"], selected["best_components"])
        + (
            f" The largest T2 is {dominance:.1f} times its limit; check that sample before trusting the axes."
            if dominance > DISTANCE_DOMINANCE
            else ""
        ),
        " ".join([prep.summary, loads.summary, stable.summary]),
        _region_text(regions.orderBy("PC", F.desc("region_strength")).collect()),
        _link_text(links) + (" " + " ".join(warnings) if warnings else " No strong metadata confounding found."),
        "Flags ask for review, clusters are not identities, and PCA separation is not predictive validation.",
        scores["note"],
    ]
    report = "\n\n".join(f"{h}\n{s}" for h, s in zip(HEADINGS, sections))
    return Audit(quality, prep, loads, choices, stable, regions, links, pairs, warnings, support, scores, report)


def _region_text(rows) -> str:
    return "; ".join(
        f"PC{r['PC']} {r['region_min']:g}-{r['region_max']:g} (peak {r['peak']:g}, {r['direction']})" for r in rows
    ) or "No dominant regions."


def _link_text(links: pd.DataFrame) -> str:
    if links.empty:
        return "No metadata column could be screened."
    return "; ".join(f"{r.metadata}: {r.strength} ({r.pca_association:.2f})" for r in links.itertuples()) + "."
