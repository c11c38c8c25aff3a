"""Transparent health subscores: step tables, unweighted mean, three bands."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd

# Step tables (threshold -> points) and bands.
Q2_STEPS = ((0.90, 95), (0.75, 85), (0.50, 70), (0.25, 50))
Q2_ELSE = 25
FLAGGED_STEPS = ((0.03, 100), (0.08, 85), (0.15, 65), (0.30, 40))
FLAGGED_ELSE = 20
CONFOUND_STEPS = ((0.80, 35), (0.60, 65))
CONFOUND_ELSE, CONFOUND_NONE = 90, 95
SUPPORT_STEPS = ((6, 100), (5, 90), (4, 80), (3, 65), (2, 40))
SUPPORT_ELSE = 20
FOLD_SD_STEPS = ((0.05, 100), (0.10, 85), (0.15, 65), (0.25, 40))
FOLD_SD_ELSE = 20
GAP_STEPS = ((0.03, 100), (0.07, 90), (0.10, 75), (0.20, 55))
GAP_ELSE = 25
BANDS = ((75, "GREEN"), (50, "YELLOW"))


def _at_least(value: float, steps, otherwise: int) -> int:
    return next((points for floor, points in steps if value >= floor), otherwise)


def _at_most(value: float, steps, otherwise: int) -> int:
    return next((points for limit, points in steps if value <= limit), otherwise)


def _known(value) -> bool:
    return value is not None and math.isfinite(value)


def overall(subscores: pd.DataFrame) -> dict:
    """Mean and band of a subscore table."""
    if subscores.empty:
        return {"score": math.nan, "band": "UNAVAILABLE"}
    score = float(subscores["score"].mean())
    return {"score": score, "band": next((b for floor, b in BANDS if score >= floor), "RED")}


def _table(rows: Sequence[tuple[str, float, str]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["component", "score", "reason"])


def model_health(
    q2: float,
    flagged_share: float,
    preprocessing: float,
    loadings: float,
    clusters: float,
    confound_v: Sequence[float],
    support: float,
) -> dict:
    """Five to seven subscores of an unsupervised analysis; unknown inputs are left out."""
    rows = []
    if _known(q2):
        rows.append(("PCA cross-validation", _at_least(q2, Q2_STEPS, Q2_ELSE), f"Q2-X {q2:.3f}"))
    if _known(flagged_share):
        rows.append(
            ("Data QC", _at_most(flagged_share, FLAGGED_STEPS, FLAGGED_ELSE), f"{100 * flagged_share:.1f}% flagged")
        )
    for name, value in (("Preprocessing stability", preprocessing), ("Loading stability", loadings)):
        if _known(value):
            rows.append((name, round(100 * value), f"stability {value:.2f}"))
    if _known(clusters):
        rows.append(("Cluster stability", round(min(100, max(0, 100 * clusters))), f"median ARI {clusters:.2f}"))
    if len(confound_v):
        worst = max(confound_v)
        rows.append(("Metadata confounding", _at_least(worst, CONFOUND_STEPS, CONFOUND_ELSE), f"largest V {worst:.2f}"))
    else:
        rows.append(("Metadata confounding", CONFOUND_NONE, "no categorical pairs to compare"))
    if _known(support):
        rows.append(
            ("Independent-group support", _at_least(support, SUPPORT_STEPS, SUPPORT_ELSE), f"smallest class has {int(support)} group(s)")
        )
    table = _table(rows)
    return {
        "subscores": table,
        **overall(table),
        "note": "An advisory summary of named thresholds, not a probability and not a statement about sample identity.",
    }


def predictive_subscores(balanced_accuracy: float, classes: int, fold_scores: Sequence[float], gap: float) -> pd.DataFrame:
    """Held-out performance above chance, fold stability and train-to-held-out gap."""
    rows = []
    if classes > 1 and _known(balanced_accuracy):
        chance = 1.0 / classes
        lifted = min(1.0, max(0.0, (balanced_accuracy - chance) / (1.0 - chance)))
        rows.append(
            ("Predictive held-out performance", round(100 * lifted), f"balanced accuracy {balanced_accuracy:.3f}, chance {chance:.3f}")
        )
    folds = [f for f in fold_scores if _known(f)]
    if folds:  # one fold has no spread
        sd = float(pd.Series(folds).std(ddof=1)) if len(folds) > 1 else 0.0
        rows.append(("Predictive fold stability", _at_most(sd, FOLD_SD_STEPS, FOLD_SD_ELSE), f"fold sd {sd:.3f}"))
    if _known(gap):
        rows.append(("Train-to-held-out gap", _at_most(gap, GAP_STEPS, GAP_ELSE), f"gap {gap:.3f}"))
    return _table(rows)


def combine_health(health: dict, predictive: pd.DataFrame) -> dict:
    """Add predictive subscores to an existing health table and re-average."""
    table = pd.concat([health["subscores"], predictive], ignore_index=True)
    return {**health, "subscores": table, **overall(table)}
