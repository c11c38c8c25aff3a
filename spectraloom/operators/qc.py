"""Sample-level quality control: interpretable measures, robust thresholds, never deletion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_matrix import to_matrix
from ..spectra import ID, Y, Spectra
from .quantiles import exact_quantiles
from .recipe import median_fill
from .tiles import SUB_ROWS, assign_group_blocks, group_tiles

# QC thresholds.
ROBUST_Z = 3.5
MAD_SCALE = 0.67448975
FLAT_RELATIVE_STD = 0.03
SATURATION_FRACTION = 0.05
SATURATION_TOLERANCE = 0.002
REPLICATE_CORRELATION = 0.95
TINY, TINY_MAD = 1e-12, 1e-15
REPLICATE_CONTEXT_ROLES = (
    "brand_or_manufacturer", "grade_or_product_type", "site_or_station", "batch_or_lot",
    "campaign_or_run", "group",
)
FLAGS = (
    "flat_flag", "extreme_intensity_flag", "high_noise_flag", "possible_saturation_flag",
    "high_baseline_flag",
)


def measures(spectra: Spectra, fill: np.ndarray | None = None) -> DataFrame:
    """Per-sample measures, computed block-wise in one narrow stage."""
    width = spectra.width
    grid = np.linspace(-1.0, 1.0, width)
    slope_weights = (grid - grid.mean()) / ((grid - grid.mean()) ** 2).sum()
    names = ("missing", "std", "range", "median", "max_abs", "noise", "baseline", "extreme")

    @F.arrow_udf("struct<" + ",".join(f"{n}:double" for n in names) + ">")
    def measure(values: pa.Array) -> pa.Array:
        raw = to_matrix(values, width)
        gaps = ~np.isfinite(raw)
        x = np.where(gaps, 0.0 if fill is None else fill, raw) if gaps.any() else raw
        low, high = x.min(axis=1), x.max(axis=1)
        span = high - low
        floor = np.maximum(span, TINY)
        bend = np.abs(np.diff(x, n=2, axis=1)) if width >= 3 else np.zeros((len(x), 1))
        tolerance = SATURATION_TOLERANCE * span[:, None]
        at_top = (x >= high[:, None] - tolerance).mean(axis=1)
        at_bottom = (x <= low[:, None] + tolerance).mean(axis=1)
        columns = (
            gaps.mean(axis=1),
            x.std(axis=1),
            span,
            np.median(x, axis=1),
            np.abs(x).max(axis=1),
            np.median(bend, axis=1) / floor,
            np.abs(x @ slope_weights) / floor,
            np.where(span <= TINY, 1.0, np.maximum(at_top, at_bottom)),
        )
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=list(names))

    m = F.col("_m")
    return spectra.signal().select(ID, measure(F.col(Y)).alias("_m")).select(
        ID,
        m["missing"].alias("missing_fraction"),
        m["std"].alias("signal_std"),
        m["range"].alias("signal_range"),
        m["median"].alias("median_signal"),
        m["max_abs"].alias("max_abs_signal"),
        m["noise"].alias("noise_ratio"),
        m["baseline"].alias("baseline_slope_ratio"),
        m["extreme"].alias("near_extreme_fraction"),
    )


@dataclass(frozen=True)
class RobustScale:
    """Center and factor with ``z = factor * (v - center)``."""

    center: float
    factor: float

    def column(self, value: str) -> Column:
        return (F.col(value) - F.lit(self.center)) * F.lit(self.factor)


def robust_scales(df: DataFrame, columns: list[str]) -> dict[str, RobustScale]:
    """Median / MAD scale per column, all columns together; sd when the MAD vanishes."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    ).select("x.k", "x.v")
    centers = {k[0]: q[0] for k, q in exact_quantiles(long, "v", [0.5], ["k"]).items()}
    center_of = F.element_at(F.create_map(*[F.lit(x) for c in centers.items() for x in c]), F.col("k"))
    away = long.select("k", F.abs(F.col("v") - center_of).alias("v"))
    mads = {k[0]: q[0] for k, q in exact_quantiles(away, "v", [0.5], ["k"]).items()}
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first() if min(mads.values()) <= TINY_MAD else None
    out = {}
    for c in columns:
        if mads[c] > TINY_MAD:
            factor = MAD_SCALE / mads[c]
        else:
            factor = 1.0 / spread[c] if spread[c] and spread[c] > TINY_MAD else 0.0
        out[c] = RobustScale(centers[c], factor)
    return out


def qc_table(spectra: Spectra, incomplete: int | None = None) -> DataFrame:
    """Measures plus advisory flags, one row per sample."""
    incomplete = spectra.profile().incomplete if incomplete is None else incomplete
    fill = median_fill(spectra) if incomplete else None
    # a few doubles per sample, read by each threshold pass and by the caller
    base = measures(spectra, fill).persist(StorageLevel.MEMORY_AND_DISK)
    std_median = exact_quantiles(base, "signal_std", [0.5])[()][0]
    scales = robust_scales(base, ["max_abs_signal", "noise_ratio", "baseline_slope_ratio"])
    floor = max(std_median * FLAT_RELATIVE_STD, TINY)

    def z(column: str) -> Column:
        return scales[column].column(column)

    flagged = base.select(
        "*",
        (F.col("signal_std") <= floor).alias("flat_flag"),
        (F.abs(z("max_abs_signal")) > ROBUST_Z).alias("extreme_intensity_flag"),
        (z("noise_ratio") > ROBUST_Z).alias("high_noise_flag"),
        ((F.col("near_extreme_fraction") >= SATURATION_FRACTION) & (F.col("signal_std") > floor)).alias(
            "possible_saturation_flag"
        ),
        (z("baseline_slope_ratio") > ROBUST_Z).alias("high_baseline_flag"),
    )
    count = sum((F.col(f).cast("int") for f in FLAGS), F.lit(0))
    return flagged.withColumn("qc_flag_count", count).withColumn("qc_review", F.col("qc_flag_count") > 0)


# ---------------------------------------------------------------- replicates


def replicate_columns(roles: dict[str, str]) -> tuple[list[str], list[str]]:
    """Replicate columns and the (at most three) columns saying what is replicated."""
    replicate = [c for c, r in roles.items() if r == "replicate"]
    context = [c for c, r in roles.items() if r in REPLICATE_CONTEXT_ROLES]
    return replicate, context[:3]


def replicate_consistency(spectra: Spectra, group: Column, fill: np.ndarray | None = None) -> DataFrame:
    """Mean and minimum pairwise Pearson correlation inside every replicate group.

    Rows are scaled to unit-length deviations ``u`` so that r = u.v.  The mean over all
    pairs follows from the group's vector sum; the minimum is taken over row-block tiles of
    bounded size, so a group of any size is spread over many tasks and no pair is emitted.
    """
    width = spectra.width

    @F.arrow_udf("array<double>")
    def unit(values: pa.Array) -> pa.Array:
        from ..functions.arrow_matrix import to_list_array

        x = to_matrix(values, width)
        if fill is not None:
            x = np.where(np.isfinite(x), x, fill)
        u = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((u * u).sum(axis=1, keepdims=True))
        with np.errstate(invalid="ignore", divide="ignore"):
            u = np.where(norm > 0, u / norm, np.nan)
        return to_list_array(u)

    units = spectra.df.select(ID, group.alias("replicate_group"), unit(F.col(Y)).alias("u"))
    usable = ~F.exists("u", lambda v: F.isnan(v))
    sizes = units.groupBy("replicate_group").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(usable).alias("m")
    ).filter("n >= 2 and m >= 2")

    def tile(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        x = to_matrix(table.column("u"), width)
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        left, right = x[block == bi], x[block == bj]
        pairs, total, lowest = 0, 0.0, np.inf
        for at in range(0, len(left), SUB_ROWS):
            part = left[at : at + SUB_ROWS]
            # on the diagonal: the strip's own pairs once, then the rows after it
            if bi == bj:
                own = (part @ part.T)[np.triu_indices(len(part), 1)]
                parts = (own, part @ left[at + SUB_ROWS :].T)
            else:
                parts = (part @ right.T,)
            for r in parts:
                pairs += r.size
                total += float(r.sum())
                lowest = min(lowest, float(r.min(initial=np.inf)))
        return pa.table(
            {
                "replicate_group": [table.column("replicate_group")[0].as_py()],
                "pairs": pa.array([pairs], pa.int64()),
                "total": [total],
                "lowest": [lowest if pairs else None],
            },
            schema=pa.schema(
                [
                    ("replicate_group", pa.string()),
                    ("pairs", pa.int64()),
                    ("total", pa.float64()),
                    ("lowest", pa.float64()),
                ]
            ),
        )

    blocked = assign_group_blocks(units.filter(usable).join(sizes, "replicate_group"), "m")
    tiles = group_tiles(
        blocked.select("replicate_group", "u", "block", "blocks"),
        ["replicate_group"],
        tile,
        "replicate_group string, pairs bigint, total double, lowest double",
    )
    return (
        tiles.groupBy("replicate_group")
        .agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"))
        .join(sizes, "replicate_group")
        .select(
            "replicate_group",
            "n",
            (F.col("total") / F.col("pairs")).alias("mean_pairwise_correlation"),
            F.col("lowest").alias("minimum_pairwise_correlation"),
            (F.col("lowest") < REPLICATE_CORRELATION).alias("warning"),
        )
    )
