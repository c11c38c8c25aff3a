"""Recipe comparison and the rule-based recommendation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import recipe
from ..operators.metadata import MetadataSchema, infer_schema, trusted_label
from ..operators.moments import Moments
from ..operators.neighbors import silhouettes
from ..operators.pca import assign_folds, cv_table, fit_pca, fold_moments, model_from_moments
from ..operators.recipe import FittedRecipe, Step, compile_chain
from ..operators.stability import planes_of
from ..spectra import ID, Profile, Spectra

# Recommendation thresholds.
Q2_TOLERANCE = 0.08
USEFUL_SEPARATION = 0.10
SNV_GROUP_GAIN, SNV_Q2_GAIN = 0.05, 0.03
NEAR_TIE_GROUP, NEAR_TIE_Q2 = 0.02, 0.02
MAX_COMPONENTS, COMPARE_FOLDS = 20, 4
MIN_SAMPLES = 6


def _top(frame: pd.DataFrame, metric: str) -> pd.Series | None:
    """Best finite row by the metric, simpler recipe first on ties."""
    known = frame[np.isfinite(frame[metric].astype(float))]
    if known.empty:
        return None
    return known.sort_values([metric, "complexity"], ascending=[False, True], kind="stable").iloc[0]


def _snv_guard(selected: pd.Series, eligible: pd.DataFrame, visual: bool) -> tuple[pd.Series, bool, str]:
    """Normalisation must beat the best plain recipe by a visible margin."""
    plain = eligible[~eligible.uses_snv.astype(bool)]
    if not selected.uses_snv or plain.empty:
        return selected, False, "SNV was not the selected recipe."
    metric, margin = ("group_separation", SNV_GROUP_GAIN) if visual else ("Q2_X", SNV_Q2_GAIN)
    what = "group separation" if visual else "Q²-X"
    rival = _top(plain, metric)
    if rival is None or selected[metric] >= rival[metric] + margin:
        return selected, False, f"SNV was kept: it gains at least {margin:.2f} {what} over the best recipe without it."
    return rival, True, f"SNV was rejected: it gains less than {margin:.2f} {what} over the best recipe without it."


def choose_recommendation(summary: pd.DataFrame, label: str | None) -> tuple[pd.Series, dict]:
    """Pick the default recipe from the comparison table by inspectable rules."""
    if summary.empty:
        raise ValueError("No PCA candidates were evaluated.")
    leader = _top(summary, "Q2_X")
    if leader is None:
        leader = summary.sort_values(["RMSECV_X", "complexity"], kind="stable").iloc[0]
        eligible = summary
    else:
        eligible = summary[summary.Q2_X >= leader.Q2_X - Q2_TOLERANCE]
    clearest = _top(eligible, "group_separation") if label else None
    visual = clearest is not None and clearest.group_separation >= USEFUL_SEPARATION
    selected, guarded, message = _snv_guard(clearest if visual else leader, eligible, visual)

    metric, slack = ("group_separation", NEAR_TIE_GROUP) if visual else ("Q2_X", NEAR_TIE_Q2)
    if math.isfinite(selected[metric]):
        near = eligible[eligible[metric] >= selected[metric] - slack]
        if math.isfinite(selected.Q2_X):
            near = near[near.Q2_X.isna() | (near.Q2_X >= selected.Q2_X - NEAR_TIE_Q2)]
        if len(near):
            simplest = near.sort_values(["complexity", metric], ascending=[True, False], kind="stable").iloc[0]
            if simplest.complexity < selected.complexity:
                selected = simplest
    decision = {
        "selected_name": str(selected["name"]),
        "selection_mode": "known-group PC1/PC2 separation" if visual else "cross-validated PCA reconstruction",
        "label_column": label,
        "best_general_name": str(leader["name"]),
        "best_general_q2": float(leader.Q2_X),
        "q2_tolerance": Q2_TOLERANCE,
        "snv_guard_applied": guarded,
        "snv_guard_message": message,
        "rules": [
            f"Only recipes within {Q2_TOLERANCE:.2f} Q²-X of the best reconstruction are considered.",
            f"Known-group PC1/PC2 separation decides only when its silhouette reaches {USEFUL_SEPARATION:.2f}.",
            f"SNV must gain {SNV_GROUP_GAIN:.2f} separation or {SNV_Q2_GAIN:.2f} Q²-X over the best recipe without it.",
            "Near ties go to the recipe with fewer operations.",
        ],
    }
    return selected, decision


def _separations(spectra: Spectra, models: Sequence, label: str, sizes: dict[str, int], n: int) -> list[float]:
    """Silhouette of the known groups on every candidate's standardised PC1/PC2 plane."""
    usable = len(sizes) >= 2 and len(sizes) < n and min(sizes.values()) >= 2
    if not usable:
        return [math.nan] * len(models)
    planes = planes_of(spectra, models)
    labels = spectra.df.select(F.col(ID).cast("bigint").alias("id"), F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("label"))
    joined = planes.join(labels, "id")
    spans = [(2 * i, 2 * i + 2) for i in range(len(models))]
    return silhouettes(joined, ["label"] * len(models), "xy", n, "id", spans)


def compare_recipes(
    spectra: Spectra,
    schema: MetadataSchema | None = None,
    max_components: int = MAX_COMPONENTS,
    folds: int = COMPARE_FOLDS,
    rule: str = "one_se",
    profile: Profile | None = None,
) -> tuple[list[dict], pd.DataFrame, dict]:
    """Cross-validate every candidate recipe and order them by the recommendation.

    With complete data, one scan accumulates the fold moments of all ten candidates; their
    cross-validation curves, full fits and component choices all follow from those moments.
    """
    profile = profile or spectra.profile()
    if profile.n < MIN_SAMPLES:
        raise ValueError(f"At least {MIN_SAMPLES} samples are required to compare recipes.")
    schema = schema or infer_schema(spectra.df, spectra.meta)
    label = trusted_label(schema)
    most = max(2, min(int(max_components), profile.n - 2, spectra.width, MAX_COMPONENTS))
    candidates = recipe.candidate_recipes(spectra.axis)
    assigned, count, mode = assign_folds(spectra, min(folds, max(2, profile.n // 4)), profile.n)
    moments = fold_moments(assigned, [steps for _, steps in candidates], count, profile)
    entries = []
    for (name, steps), parts in zip(candidates, moments):
        cv, best = cv_table(parts, most, mode, rule)
        best = max(2, best)
        row = cv[cv.components == best].iloc[0]
        if parts[0].shared:
            model = _from_folds(spectra, steps, parts[0].train + parts[0].test, best)
        else:
            model = fit_pca(spectra, steps, best, profile)
        entries.append(
            {
                "name": name, "steps": steps, "cv": cv, "best_components": best, "model": model,
                "components": best, "Q2_X": float(row.Q2_X), "RMSECV_X": float(row.RMSECV_X),
                "PC1_PC2_percent": float(100 * model.ratio[:2].sum()), "group_separation": math.nan,
                "label_used_for_display_score": label or "", "uses_snv": recipe.uses_snv(steps),
                "complexity": recipe.complexity(steps), "recipe": recipe.describe(steps),
            }
        )
    if label:
        rows = spectra.df.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("nan")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = {r["c"]: r["n"] for r in rows}
        for e, s in zip(entries, _separations(spectra, [e["model"] for e in entries], label, sizes, profile.n)):
            e["group_separation"] = s
    hidden = ("steps", "cv", "best_components", "model")
    summary = pd.DataFrame([{k: v for k, v in e.items() if k not in hidden} for e in entries])
    chosen, decision = choose_recommendation(summary, label)
    summary["objective"] = (summary["name"] == chosen["name"]).astype(float)
    summary["recommendation"] = "compare"
    summary.loc[summary["name"] == decision["best_general_name"], "recommendation"] = "best reconstruction"
    summary.loc[summary.objective == 1.0, "recommendation"] = "DEFAULT"
    keys = {"objective": False, "Q2_X": False, "complexity": True}
    if label and summary.group_separation.notna().any():
        keys = {"objective": False, "group_separation": False, "Q2_X": False, "complexity": True}
    summary = summary.sort_values(list(keys), ascending=list(keys.values()), kind="stable", ignore_index=True)
    by_name = {e["name"]: e for e in entries}
    return [by_name[name] for name in summary["name"]], summary, decision


def _from_folds(spectra: Spectra, steps: Sequence[Step], whole: Moments, components: int):
    """Full fit from already accumulated moments: the trailing center is the total mean."""
    last = max(i for i, s in enumerate(steps) if s.name == "Mean center")
    center = whole.mean + whole.pivot
    state = {last: (center, np.ones_like(center))}
    fitted = FittedRecipe(tuple(steps), state, None, compile_chain(spectra.axis, steps, state))
    shifted = Moments(whole.n, whole.total, whole.gram, whole.pivot - center)
    return model_from_moments(fitted, shifted, components)


def snv_summary(table: pd.DataFrame, label: str | None) -> str:
    """Best recipe with SNV against best without it, in words."""
    with_snv, without = table[table.uses_snv.astype(bool)], table[~table.uses_snv.astype(bool)]
    metrics = ["group_separation", "Q2_X"] if label else ["Q2_X"]
    for metric in metrics:
        a, b = _top(with_snv, metric), _top(without, metric)
        if a is not None and b is not None:
            change = a[metric] - b[metric]
            what = "PC1/PC2 group separation" if metric == "group_separation" else "reconstruction Q²-X"
            return (
                f"SNV check: best with SNV {a[metric]:.3f}, best without {b[metric]:.3f}; "
                f"SNV {'improved' if change > 0 else 'reduced'} {what} by {abs(change):.3f}."
            )
    return "SNV comparison was not available."
