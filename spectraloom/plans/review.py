"""Review of single optimization trials, and defaults that follow from a data set's size."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_matrix import to_list_array, to_matrix
from ..operators import recipe
from ..operators.moments import accumulate
from ..operators.pca import decompose
from ..operators.recipe import Chain, Step, column_moments, fit_recipe
from ..spectra import ID, Y, Spectra

#: Result columns of an exported history row that hold a family's own parameters, and their kinds.
PARAMETERS = {
    "SVM": {"C": float, "kernel": str, "gamma": lambda v: v if isinstance(v, str) and not _is_number(v) else float(v)},
    "Random Forest": {"trees": int, "depth": lambda v: None if _missing(v) else int(v), "leaf": int},
    "PLS-DA": {"pls_components": int},
}
SHOWN = 3


def _missing(value: object) -> bool:
    return value is None or value == "" or isinstance(value, float) and math.isnan(value)


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def _truth(value: object) -> bool:
    return value.strip().lower() in ("true", "1") if isinstance(value, str) else not _missing(value) and bool(value)


def trial_candidate(row: Mapping) -> tuple[list[Step], dict]:
    """Steps and parameters of a history row, also of one read back from CSV."""
    family = str(row["model"])
    if family not in PARAMETERS:
        raise ValueError(f"Unknown model family: {family}")
    use_pca = _truth(row.get("use_pca"))
    pcs = int(float(row["pcs"])) if use_pca and not _missing(row.get("pcs")) else 0
    own = {name: kind(row.get(name)) for name, kind in PARAMETERS[family].items()}
    return recipe.from_json(str(row["recipe"])), {"model": family, "use_pca": use_pca, "pcs": pcs, **own}


@dataclass(frozen=True)
class Projection:
    scores: DataFrame
    steps: list[Step]
    recipe_text: str
    description: str
    display_only: bool
    uses_model_pca: bool


def trial_projection(spectra: Spectra, row: Mapping, shown: int = SHOWN) -> Projection:
    """``(sample_index, scores)`` of the space that a trial's classifier works in.

    A trial that projects shows the first axes of its own PCA; one that does not is shown through a
    PCA made for display, of exactly the variables that its classifier sees.
    """
    steps = recipe.from_json(str(row["recipe"]))
    profile = spectra.profile()
    chain: Chain = fit_recipe(spectra, steps, profile.incomplete).chain
    width = len(chain.axis)
    most = min(profile.n - 1, width)
    uses = _truth(row.get("use_pca"))
    wanted = int(float(row["pcs"])) if uses and not _missing(row.get("pcs")) else 2
    kept = max(2, min(wanted, most)) if uses else max(2, min(int(shown), most))
    visible = min(int(shown), kept, width)

    shift, scale = np.zeros(width), np.ones(width)
    if str(row.get("model")) == "SVM":
        _, shift, variance = column_moments(spectra.df.select(chain.column().alias(Y)))
        scale = np.where(variance > 0, np.sqrt(variance), 1.0)
    pivot = chain.apply(profile.reference[None, :])[0]
    moments = accumulate(spectra.signal(), [chain], [pivot])[(0, 0)]
    # scaling columns scales their moments
    values, vectors = decompose(moments.scatter() / np.outer(scale, scale))
    axes = vectors[:, :visible] / scale[:, None]
    mean = moments.mean + moments.pivot

    @F.arrow_udf("array<double>")
    def project(values_: pa.Array) -> pa.Array:
        return to_list_array((chain.apply(to_matrix(values_, chain.width_in)) - mean) @ axes)

    text = (
        f"This trial's model itself projects to {kept} components; shown are the first {visible} axes."
        if uses
        else f"This trial's classifier works without a projection; its processed variables are shown in {visible} components for display only."
    )
    scores = spectra.df.select(ID, project(F.col(Y)).alias("scores"))
    return Projection(scores, steps, recipe.describe(steps), text, not uses, uses)


def dataset_defaults(n: int, points: int) -> dict[str, float]:
    """Starting values that follow from the numbers of samples and axis points."""
    sparse = next((d for bound, d in ((60, 0.05), (250, 0.10)) if n < bound), 0.15)
    within = lambda low, value, high: max(low, min(high, value))
    return {
        "neighbors": within(5, round(2.0 * math.sqrt(max(4, n))), 40),
        "min_distance": sparse,
        "components": within(3, min(n - 2, points), 20),
        "max_components": within(2, min(n - 2, points), 25),
    }


def validation_defaults(eligible: DataFrame) -> dict[str, int]:
    """Fold counts and least groups from the eligible class with the fewest independent groups."""
    least = eligible.agg(F.min("independent_groups").alias("m")).first()["m"]
    if least is None:
        return {}
    within = lambda value, high: max(2, min(high, value))
    return {"min_groups": within(least, 3), "outer_folds": within(least, 5), "inner_folds": within(max(2, least - 1), 3)}
