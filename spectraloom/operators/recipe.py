"""Preprocessing recipes.

A recipe is an ordered list of steps.  Enabled steps compile to a short chain of block
functions executed by one Arrow scalar function over the array column, so a whole recipe
is a single narrow stage: no shuffle, no explode, metadata columns untouched.  Only
centering / scaling steps need training statistics; those are fitted by one aggregation
and then frozen into the chain, which is what keeps held-out rows out of every fit.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranges, smoothing
from ..functions.arrow_matrix import to_list_array, to_matrix
from ..functions.spectrum import trapezoid_weights
from ..spectra import ID, Y, Spectra
from .position_quantiles import array_quantiles, extents
from .quantiles import GATHER_BOUND, exact_quantiles

# Default parameters of every step, and the canonical stage order.
STEP_DEFAULTS = {
    "Range": {"minimum": 400.0, "maximum": 4000.0},
    "Exclude": {"ranges": ""},
    "Baseline polynomial": {"order": 2},
    "Savitzky-Golay": {"window": 11, "poly": 2},
    "Derivative": {"order": 1, "window": 11, "poly": 2},
    "SNV": {},
    "Vector normalize": {},
    "Area normalize": {},
    "Mean center": {},
    "Autoscale": {},
    "Robust scale": {},
}
STAGE_ORDER = {
    "Range": 0,
    "Exclude": 1,
    "Baseline polynomial": 2,
    "Savitzky-Golay": 3,
    "Derivative": 4,
    "SNV": 5,
    "Vector normalize": 5,
    "Area normalize": 5,
    "Mean center": 6,
    "Autoscale": 6,
    "Robust scale": 6,
}
FITTED = ("Mean center", "Autoscale", "Robust scale")

Block = Callable[[np.ndarray], np.ndarray]
State = dict[int, tuple[np.ndarray, np.ndarray]]


@dataclass
class Step:
    name: str
    params: dict = field(default_factory=dict)
    enabled: bool = True

    def setting(self, key: str):
        return self.params.get(key, STEP_DEFAULTS.get(self.name, {}).get(key))


def ordered_steps(steps: Sequence[Step]) -> list[Step]:
    """Stable sort into the canonical stage order."""
    return sorted(steps, key=lambda s: STAGE_ORDER.get(s.name, 99))


def to_json(steps: Sequence[Step]) -> str:
    """Canonical text of a recipe; equal recipes have equal text."""
    return json.dumps([asdict(s) for s in steps], sort_keys=True)


def from_json(text: str) -> list[Step]:
    return [Step(**item) for item in json.loads(text)]


def uses_snv(steps: Sequence[Step]) -> bool:
    return any(s.enabled and s.name == "SNV" for s in steps)


def complexity(steps: Sequence[Step]) -> int:
    """Enabled operations other than range selection and mean centering."""
    return len([s for s in steps if s.enabled and s.name not in ("Range", "Mean center")])


def describe(steps: Sequence[Step]) -> str:
    def one(s: Step) -> str:
        inner = ", ".join(f"{k}={v}" for k, v in s.params.items())
        return f"{s.name} ({inner})" if inner else s.name

    return " → ".join(one(s) for s in steps if s.enabled)


# ---------------------------------------------------------------- block functions


def _snv(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1.0, sd)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1.0, norm)


def _area(w: np.ndarray) -> Block:
    def block(x):
        area = (np.abs(x) @ w)[:, None]
        return x / np.where(area == 0, 1.0, area)

    return block


def _take(positions: np.ndarray) -> Block:
    return lambda x: np.ascontiguousarray(x[:, positions])


def _affine(shift: np.ndarray, scale: np.ndarray) -> Block:
    return lambda x: (x - shift) / scale


def _filler(values: np.ndarray) -> Block:
    return lambda x: np.where(np.isfinite(x), x, values)


def _savgol(window: int, poly: int, deriv: int) -> Block:
    return lambda x: smoothing.savgol(x, window, poly, deriv)


def _baseline(order: int) -> Block:
    return lambda x: smoothing.remove_baseline(x, order)


@dataclass(frozen=True)
class Chain:
    """Compiled prefix of a recipe: block functions plus the resulting axis."""

    blocks: tuple[Block, ...]
    axis: np.ndarray
    width_in: int
    pending: int | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        for block in self.blocks:
            x = block(x)
        return x

    def column(self, y: Column | str = Y) -> Column:
        """The chain as one Arrow column function."""
        if not self.blocks:
            return F.col(y) if isinstance(y, str) else y
        chain = self

        @F.arrow_udf("array<double>")
        def run(values: pa.Array) -> pa.Array:
            return to_list_array(chain.apply(to_matrix(values, chain.width_in)))

        return run(y)


def compile_chain(
    axis: np.ndarray, steps: Sequence[Step], state: State | None = None, fill: np.ndarray | None = None
) -> Chain:
    """Compile enabled steps in order, stopping before the first step that still needs fitting."""
    state = state or {}
    axis = np.asarray(axis, dtype=float)
    width_in = len(axis)
    blocks: list[Block] = [] if fill is None else [_filler(np.asarray(fill, dtype=float))]
    for i, step in enumerate(steps):
        if not step.enabled:
            continue
        if step.name in ("Range", "Exclude"):
            if step.name == "Range":
                span = [(float(step.setting("minimum")), float(step.setting("maximum")))]
                kept = np.flatnonzero(ranges.inside(axis, span))
            else:
                kept = np.flatnonzero(~ranges.inside(axis, ranges.parse_ranges(step.setting("ranges") or "")))
            if len(kept) < len(axis):
                blocks.append(_take(kept))
                axis = axis[kept]
        elif step.name == "Baseline polynomial":
            blocks.append(_baseline(int(step.setting("order"))))
        elif step.name in ("Savitzky-Golay", "Derivative"):
            deriv = int(step.setting("order")) if step.name == "Derivative" else 0
            window, poly = int(step.setting("window")), int(step.setting("poly"))
            smoothing.effective_window(len(axis), window, poly)
            blocks.append(_savgol(window, poly, deriv))
        elif step.name == "SNV":
            blocks.append(_snv)
        elif step.name == "Vector normalize":
            blocks.append(_unit)
        elif step.name == "Area normalize":
            blocks.append(_area(trapezoid_weights(axis)))
        elif step.name in FITTED:
            if i not in state:
                return Chain(tuple(blocks), axis, width_in, i)
            blocks.append(_affine(*state[i]))
    if len(axis) < 2:
        raise ValueError("Recipe leaves fewer than 2 spectral variables.")
    return Chain(tuple(blocks), axis, width_in)


# ---------------------------------------------------------------- fitting


def column_moments(df: DataFrame, y: str = Y) -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, mean, population variance)`` per array position in one map-side combined pass."""
    vector = array_to_vector(F.col(y)).alias("_vec")
    row = (
        df.select(vector)
        .agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("_vec")).alias("s"))
        .select(
            F.col("s.count").alias("n"),
            vector_to_array("s.mean").alias("mean"),
            vector_to_array("s.variance").alias("variance"),
        )
        .first()
    )
    n = row["n"]
    return n, np.array(row["mean"]), np.array(row["variance"]) * ((n - 1) / n if n > 1 else 0.0)


def position_quantiles(df: DataFrame, width: int, probs: Sequence[float], y: str = Y) -> np.ndarray:
    """``width x len(probs)`` exact quantiles per array position (NaN where nothing is present).

    Few rows are sorted by the built-in percentile; more never become cells, see ``array_quantiles``.
    """
    known = extents(df, width, y)
    if known[0].max(initial=0) > GATHER_BOUND:
        return array_quantiles(df, width, probs, y, known)
    cells = df.select(F.posexplode(y).alias("pos", "v"))
    found = exact_quantiles(cells, "v", probs, ["pos"])
    return np.array([found.get((p,), [np.nan] * len(probs)) for p in range(width)])


def median_fill(spectra: Spectra) -> np.ndarray:
    """Per-position median used to fill gaps; a position with no value at all fills with 0."""
    return np.nan_to_num(position_quantiles(spectra.df, spectra.width, [0.5])[:, 0])


def fit_state(spectra: Spectra, steps: Sequence[Step], fill: np.ndarray | None = None) -> State:
    """Fit every centering / scaling step on ``spectra`` (the training rows)."""
    state: State = {}
    while True:
        chain = compile_chain(spectra.axis, steps, state, fill)
        if chain.pending is None:
            return state
        processed = spectra.df.select(chain.column().alias(Y))
        kind = steps[chain.pending].name
        if kind == "Robust scale":
            q = position_quantiles(processed, len(chain.axis), [0.25, 0.5, 0.75])
            shift, scale = q[:, 1], q[:, 2] - q[:, 0]
        else:
            _, shift, variance = column_moments(processed)
            scale = np.sqrt(variance) if kind == "Autoscale" else np.ones_like(shift)
        state[chain.pending] = (shift, np.where(scale == 0, 1.0, scale))


@dataclass(frozen=True)
class FittedRecipe:
    """A recipe with frozen parameters: usable on held-out rows, new batches or a stream."""

    steps: tuple[Step, ...]
    state: State
    fill: np.ndarray | None
    chain: Chain

    @property
    def axis(self) -> np.ndarray:
        return self.chain.axis

    def transform(self, spectra: Spectra) -> Spectra:
        return spectra.with_y(self.chain.column(), self.chain.axis)


def fit_recipe(spectra: Spectra, steps: Sequence[Step], incomplete: int | None = None) -> FittedRecipe:
    """Median imputation (only when gaps exist) followed by the fitted recipe."""
    incomplete = spectra.profile().incomplete if incomplete is None else incomplete
    fill = median_fill(spectra) if incomplete else None
    state = fit_state(spectra, steps, fill)
    return FittedRecipe(tuple(steps), state, fill, compile_chain(spectra.axis, steps, state, fill))


def apply_recipe(
    spectra: Spectra, steps: Sequence[Step], state: State | None = None
) -> tuple[Spectra, State]:
    """Apply a recipe, fitting on this very table when no state is given (no imputation)."""
    state = fit_state(spectra, steps) if state is None else state
    chain = compile_chain(spectra.axis, steps, state)
    return spectra.with_y(chain.column(), chain.axis), state


# ---------------------------------------------------------------- candidate recipes


def candidate_recipes(axis: np.ndarray, width: int | None = None) -> list[tuple[str, list[Step]]]:
    """The explicit candidates compared by the guided analysis, each with and without SNV."""
    axis = np.asarray(axis, dtype=float)
    width = len(axis) if width is None else int(width)
    window = smoothing.suggest_window(width)

    def full(*middle: Step) -> list[Step]:
        span = Step("Range", {"minimum": float(np.nanmin(axis)), "maximum": float(np.nanmax(axis))})
        return [span, *middle, Step("Mean center")]

    def smooth():
        return Step("Savitzky-Golay", {"window": window, "poly": 2})

    def slope(order, w=window, poly=2):
        return Step("Derivative", {"order": order, "window": w, "poly": poly})

    def baseline():
        return Step("Baseline polynomial", {"order": 2})

    # Candidate names and their order (ties between recipes resolve by it).
    table = [
        ("Mean-centered raw", []),
        ("Smoothed + mean center", [smooth()]),
        ("1st derivative + mean center", [slope(1)]),
        ("2nd derivative + mean center", [slope(2)]),
        ("1st derivative (window 21, poly 3) + mean center", [slope(1, 21, 3)]),
        ("Baseline corrected + mean center", [baseline()]),
        ("SNV + mean center", [Step("SNV")]),
        ("Smoothed + SNV + mean center", [smooth(), Step("SNV")]),
        ("1st derivative + SNV + mean center", [slope(1), Step("SNV")]),
        ("Baseline corrected + SNV + mean center", [baseline(), Step("SNV")]),
    ]
    if width < 21:
        table = [row for row in table if "window 21" not in row[0]]
    return [(name, full(*middle)) for name, middle in table]


def search_recipes(axis: np.ndarray, base: Sequence[Step] | None) -> list[tuple[str, list[Step]]]:
    """Candidates for the supervised search: the user's own recipe first when it is distinct."""
    named = candidate_recipes(axis)
    if base and to_json(base) not in {to_json(steps) for _, steps in named}:
        named.insert(0, ("Current expert recipe", list(base)))
    return named
