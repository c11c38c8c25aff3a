"""Principal components from Gram moments, reconstruction cross-validation and diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.arrow_matrix import to_list_array, to_matrix
from ..functions.spectrum import literal
from ..spectra import ID, Y, Profile, Spectra
from .folds import group_folds, row_folds
from .moments import Moments, accumulate
from .quantiles import exact_quantiles
from .recipe import Chain, FittedRecipe, Step, compile_chain, fit_recipe, fit_state, median_fill

EIGEN_FLOOR = 1e-12


def decompose(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Descending eigenpairs; each vector's largest-magnitude entry is made positive."""
    values, vectors = np.linalg.eigh(scatter)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    peak = np.argmax(np.abs(vectors), axis=0)
    sign = np.where(vectors[peak, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return values, vectors * sign


@dataclass(frozen=True)
class PcaModel:
    """Frozen recipe + principal axes.  Small: it ships inside task closures."""

    recipe: FittedRecipe
    n: int
    mean: np.ndarray
    loadings: np.ndarray
    eigenvalues: np.ndarray  # all of them, sample-variance scale

    @property
    def components(self) -> int:
        return self.loadings.shape[1]

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues[: self.components]

    @property
    def ratio(self) -> np.ndarray:
        whole = self.eigenvalues.sum()
        return self.explained / whole if whole > 0 else np.zeros(self.components)

    @property
    def axis(self) -> np.ndarray:
        return self.recipe.axis

    def scores(self, spectra: Spectra) -> DataFrame:
        """Input rows (metadata kept) plus ``scores ARRAY<DOUBLE>``; the raw array is dropped."""
        chain, mean, loadings = self.recipe.chain, self.mean, self.loadings

        @F.arrow_udf("array<double>")
        def project(values: pa.Array) -> pa.Array:
            return to_list_array((chain.apply(to_matrix(values, chain.width_in)) - mean) @ loadings)

        return spectra.df.select(ID, *spectra.meta, project(F.col(Y)).alias("scores"))

    def scored(self, spectra: Spectra) -> DataFrame:
        """``scores`` plus Hotelling T2 and Q residual from one pass over the array."""
        chain, mean, loadings = self.recipe.chain, self.mean, self.loadings
        eig = np.maximum(self.explained, EIGEN_FLOOR)

        @F.arrow_udf("struct<scores:array<double>,t2:double,q:double>")
        def score(values: pa.Array) -> pa.Array:
            z = chain.apply(to_matrix(values, chain.width_in)) - mean
            t = z @ loadings
            residual = z - t @ loadings.T
            return pa.StructArray.from_arrays(
                [
                    to_list_array(t),
                    pa.array((t * t / eig).sum(axis=1)),
                    pa.array((residual * residual).sum(axis=1)),
                ],
                names=["scores", "t2", "q"],
            )

        return spectra.df.select(ID, *spectra.meta, score(F.col(Y)).alias("_s")).select(
            ID,
            *spectra.meta,
            F.col("_s.scores").alias("scores"),
            F.col("_s.t2").alias("Hotelling_T2"),
            F.col("_s.q").alias("Q_residual"),
        )

    def loadings_table(self, spark) -> DataFrame:
        """Long loadings ``(PC, pos, wn, loading)``; axis-sized."""
        frame = pd.DataFrame(
            {
                "PC": np.repeat(np.arange(1, self.components + 1), len(self.axis)),
                "pos": np.tile(np.arange(len(self.axis)), self.components),
                "wn": np.tile(self.axis, self.components),
                "loading": self.loadings.T.ravel(),
            }
        )
        return spark.createDataFrame(frame, "PC int, pos int, wn double, loading double")


def model_from_moments(recipe: FittedRecipe, moments: Moments, components: int) -> PcaModel:
    n = int(round(moments.n))
    values, vectors = decompose(moments.scatter())
    count = max(1, min(int(components), n - 1, len(recipe.axis)))
    rank = min(n - 1, len(recipe.axis))
    return PcaModel(
        recipe,
        n,
        moments.mean + moments.pivot,
        vectors[:, :count],
        values[:rank] / max(n - 1, 1),
    )


def fit_pca(
    spectra: Spectra, steps: Sequence[Step], components: int = 20, profile: Profile | None = None
) -> PcaModel:
    """Impute, preprocess and decompose; one Gram pass beyond what the recipe itself needs."""
    profile = profile or spectra.profile()
    if profile.n < 2:
        raise ValueError("PCA needs at least two samples.")
    recipe = fit_recipe(spectra, steps, profile.incomplete)
    pivot = recipe.chain.apply(profile.reference[None, :])[0]
    moments = accumulate(spectra.signal(), [recipe.chain], [pivot])[(0, 0)]
    return model_from_moments(recipe, moments, components)


# ---------------------------------------------------------------- cross-validation


@dataclass(frozen=True)
class FoldMoments:
    train: Moments
    test: Moments
    shared: bool = False  # all folds live in the same processed space


def center_is_last(steps: Sequence[Step]) -> bool:
    fitted = [s for s in steps if s.enabled and s.name in ("Mean center", "Autoscale", "Robust scale")]
    if not fitted:
        return True
    active = [s for s in steps if s.enabled]
    return len(fitted) == 1 and active[-1].name == "Mean center"


def stateless(axis, steps: Sequence[Step]) -> Chain:
    """The part of a trailing-mean-center recipe that needs no fitting (PCA centers anyway)."""
    return compile_chain(axis, [s for s in steps if s.name != "Mean center" or not s.enabled])


def fold_moments(
    assigned: Spectra, recipes: Sequence[Sequence[Step]], folds: int, profile: Profile
) -> list[list[FoldMoments]]:
    """Train / test moments per recipe and fold.

    Complete data and recipes that only mean-center: all recipes and folds come from one
    scan, and each training set is the total minus its fold.  Otherwise imputation and
    scaling are refitted on every training set, one scan per fold.
    """
    shared = profile.incomplete == 0 and all(center_is_last(r) for r in recipes)
    if shared:
        chains = [stateless(assigned.axis, r) for r in recipes]
        pivots = [c.apply(profile.reference[None, :])[0] for c in chains]
        parts = accumulate(assigned.df, chains, pivots, key="fold")
        out = []
        for c in range(len(chains)):
            by_fold = [parts[(c, f)] for f in range(folds)]
            whole = by_fold[0]
            for m in by_fold[1:]:
                whole = whole + m
            out.append([FoldMoments(whole - m, m, True) for m in by_fold])
        return out
    per_fold = []
    for f in range(folds):
        train = assigned.filter(F.col("fold") != f)
        fill = median_fill(train) if profile.incomplete else None
        chains = [
            compile_chain(assigned.axis, r, fit_state(train, r, fill), fill) for r in recipes
        ]
        pivots = [c.apply(profile.reference[None, :])[0] for c in chains]
        marked = assigned.df.withColumn("_test", (F.col("fold") == f).cast("int"))
        parts = accumulate(marked, chains, pivots, key="_test")
        per_fold.append([FoldMoments(parts[(c, 0)], parts[(c, 1)]) for c in range(len(chains))])
    return [[per_fold[f][c] for f in range(folds)] for c in range(len(recipes))]


def _fold_curve(fold: FoldMoments, nmax: int) -> dict[str, np.ndarray]:
    """Calibration MSE, held-out MSE, PRESS for k = 1..nmax and the fold's TSS."""
    train, test = fold.train, fold.test
    width = len(train.total)
    values, vectors = decompose(train.scatter())
    held_out = test.scatter(train.mean)
    limit = min(nmax, int(round(train.n)) - 1, width)
    captured = np.einsum("ij,ik,kj->j", vectors[:, :limit], held_out, vectors[:, :limit])
    tss = float(np.trace(held_out))
    at = np.minimum(np.arange(1, nmax + 1), limit) - 1
    press = np.maximum(tss - np.cumsum(captured), 0.0)[at]
    calibration = np.maximum(values.sum() - np.cumsum(values[:limit]), 0.0)[at]
    return {
        "cal": np.sqrt(calibration / (train.n * width)),
        "val": np.sqrt(press / (test.n * width)),
        "press": press,
        "tss": np.full(nmax, tss),
    }


def cv_table(
    folds: Sequence[FoldMoments], max_components: int, mode: str, rule: str = "one_se"
) -> tuple[pd.DataFrame, int]:
    """The per-component curve and the parsimonious choice, from moments alone."""
    n = int(round(folds[0].train.n + folds[0].test.n))
    width = len(folds[0].train.total)
    nmax = max(1, min(int(max_components), n - 2, width))
    nmax = min(nmax, min(int(round(f.train.n)) - 1 for f in folds))
    if nmax < 1:
        raise ValueError("Cross-validation folds are too small to fit PCA.")
    curves = [_fold_curve(f, nmax) for f in folds]
    stack = {k: np.array([c[k] for c in curves]) for k in curves[0]}
    whole = decompose((folds[0].train + folds[0].test).scatter())[0] if folds[0].shared else None
    explained = whole[:nmax] / whole.sum() if whole is not None and whole.sum() > 0 else np.full(nmax, np.nan)
    press, tss = stack["press"].sum(axis=0), stack["tss"].sum(axis=0)
    sd = stack["val"].std(axis=0, ddof=1) if len(folds) > 1 else np.zeros(nmax)
    frame = pd.DataFrame(
        {
            "components": np.arange(1, nmax + 1),
            "RMSEC_X": stack["cal"].mean(axis=0),
            "RMSECV_X": stack["val"].mean(axis=0),
            "RMSECV_X_SD": sd,
            "RMSECV_X_SE": sd / math.sqrt(len(folds)),
            "RMSECV_X_BestFold": stack["val"].min(axis=0),
            "RMSECV_X_WorstFold": stack["val"].max(axis=0),
            "PRESS_X": press,
            "Q2_X": np.where(tss > 0, 1.0 - press / np.where(tss > 0, tss, 1.0), np.nan),
            "ExplainedVariance_X": explained,
            "CumulativeExplainedVariance_X": np.cumsum(explained),
            "validation_mode": mode,
            "folds": len(folds),
        }
    )
    slack = frame["RMSECV_X_SE" if rule == "one_se" else "RMSECV_X_SD"]
    lowest = int(frame.RMSECV_X.to_numpy().argmin())
    threshold = frame.RMSECV_X[lowest] + slack[lowest]
    within = frame.RMSECV_X <= threshold
    best = int(frame.components[within].min())
    frame["within_one_standard_error_of_minimum"] = within
    frame["recommended"] = frame.components == best
    frame.attrs.update(
        minimum_rmsecv_components=int(frame.components[lowest]),
        minimum_rmsecv=float(frame.RMSECV_X[lowest]),
        one_se_threshold=float(threshold),
    )
    return frame, best


def assign_folds(
    spectra: Spectra, folds: int, n: int, group: str | None = None, seed: int = 42
) -> tuple[Spectra, int, str]:
    """Attach a ``fold`` column: shuffled K-fold of rows, or whole groups per fold."""
    if group is None:
        count = min(int(folds), n)
        if count < 2:
            raise ValueError("At least two folds are required.")
        df = row_folds(spectra.df, ID, count, seed, n=n)
        return Spectra(df, spectra.axis, spectra.meta), count, "K-fold"
    keyed = spectra.df.withColumn("_g", F.col(group).cast("string"))
    sizes = keyed.groupBy(F.col("_g").alias("group")).agg(F.count(F.lit(1)).alias("rows"))
    count = min(int(folds), sizes.count())
    if count < 2:
        raise ValueError("At least two independent groups are required for grouped PCA CV.")
    dealt = group_folds(sizes.withColumn("label", F.lit("all")), count, seed).select(
        F.col("group").alias("_g"), "fold"
    )
    df = keyed.join(dealt, "_g").drop("_g")
    return Spectra(df, spectra.axis, spectra.meta), count, "grouped"


def pca_cv(
    spectra: Spectra,
    steps: Sequence[Step],
    max_components: int = 30,
    folds: int = 5,
    group: str | None = None,
    rule: str = "one_se",
    profile: Profile | None = None,
) -> tuple[pd.DataFrame, int]:
    """Reconstruction cross-validation curve and the chosen component count."""
    profile = profile or spectra.profile()
    if profile.n < 4:
        raise ValueError("At least four samples are required for PCA cross-validation.")
    assigned, count, mode = assign_folds(spectra, folds, profile.n, group)
    moments = fold_moments(assigned, [steps], count, profile)[0]
    frame, best = cv_table(moments, max_components, mode, rule)
    if frame.ExplainedVariance_X.isna().all():
        ratio = fit_pca(spectra, steps, len(frame), profile).ratio
        frame.loc[: len(ratio) - 1, "ExplainedVariance_X"] = ratio[: len(frame)]
        frame["CumulativeExplainedVariance_X"] = frame.ExplainedVariance_X.cumsum()
    return frame, best


# ---------------------------------------------------------------- diagnostics


def t2_limit(model: PcaModel, alpha: float) -> float | None:
    a, n = model.components, model.n
    if n <= a:
        return None
    return a * (n - 1) / (n - a) * special.f_quantile(alpha, a, n - a)


def q_limit(model: PcaModel, alpha: float) -> float | None:
    """Jackson-Mudholkar limit from the residual eigenvalues; None when there are none."""
    tail = model.eigenvalues[model.components :]
    tail = tail[tail > 1e-15]
    theta1, theta2, theta3 = (float((tail**k).sum()) for k in (1, 2, 3))
    if not len(tail) or theta1 <= 0 or theta2 <= 0:
        return None
    h0 = max(1.0 - 2.0 * theta1 * theta3 / (3.0 * theta2 * theta2), 1e-6)
    z = special.normal_quantile(alpha)
    bracket = z * math.sqrt(2.0 * theta2 * h0 * h0) / theta1 + 1.0 + theta2 * h0 * (h0 - 1.0) / theta1**2
    return theta1 * max(bracket, 1e-12) ** (1.0 / h0)


@dataclass(frozen=True)
class Diagnostics:
    table: DataFrame
    t2_limit: float
    q_limit: float
    alpha: float


def diagnostics(model: PcaModel, spectra: Spectra, alpha: float = 0.95) -> Diagnostics:
    """Hotelling T2 and Q residual with review flags; rows are flagged, never removed."""
    scored = model.scored(spectra).drop("scores")
    limits = []
    for value, column in ((t2_limit(model, alpha), "Hotelling_T2"), (q_limit(model, alpha), "Q_residual")):
        if value is None:
            value = exact_quantiles(scored, column, [alpha])[()][0]
        limits.append(float(value))
    table = scored.select(
        ID,
        "Hotelling_T2",
        "Q_residual",
        (F.col("Hotelling_T2") > limits[0]).alias("T2_flag"),
        (F.col("Q_residual") > limits[1]).alias("Q_flag"),
    ).withColumn("review_flag", F.col("T2_flag") | F.col("Q_flag"))
    return Diagnostics(table, limits[0], limits[1], alpha)


def sample_contributions(model: PcaModel, spectra: Spectra, sample_index: int) -> DataFrame:
    """Per-wavenumber contributions of one sample; each is also scaled by its own maximum."""
    row = spectra.filter(F.col(ID) == int(sample_index))
    if not row.df.limit(1).count():
        raise IndexError("Sample index is out of range.")
    return contributions(model, row)


def contributions(model: PcaModel, spectra: Spectra) -> DataFrame:
    """Long ``(sample_index, wavenumber, Q_contribution, T2_...)`` for every given sample."""
    chain, mean, loadings = model.recipe.chain, model.mean, model.loadings
    root = np.sqrt(np.maximum(model.explained, EIGEN_FLOOR))

    @F.arrow_udf("struct<q:array<double>,t2:array<double>>")
    def split(values: pa.Array) -> pa.Array:
        z = chain.apply(to_matrix(values, chain.width_in)) - mean
        t = z @ loadings
        return pa.StructArray.from_arrays(
            [to_list_array((z - t @ loadings.T) ** 2), to_list_array((t / root) @ loadings.T)],
            names=["q", "t2"],
        )

    top = lambda a: F.greatest(F.array_max(a), F.lit(1e-12))
    parts = spectra.df.select(ID, split(F.col(Y)).alias("_s")).select(
        ID, F.col("_s.q").alias("q"), F.col("_s.t2").alias("t2")
    )
    square = F.transform("t2", lambda v: v * v)
    return (
        parts.select(
            ID,
            top(F.col("q")).alias("_qm"),
            top(square).alias("_tm"),
            F.posexplode(F.arrays_zip(literal(model.axis).alias("wn"), "q", "t2")).alias("pos", "c"),
        )
        .select(
            ID,
            F.col("c.wn").alias("wavenumber"),
            F.col("c.q").alias("Q_contribution"),
            (F.col("c.t2") * F.col("c.t2")).alias("T2_related_contribution"),
            F.col("c.t2").alias("T2_signed_direction"),
            (F.col("c.q") / F.col("_qm")).alias("Q_scaled"),
            (F.col("c.t2") * F.col("c.t2") / F.col("_tm")).alias("T2_scaled"),
        )
    )
