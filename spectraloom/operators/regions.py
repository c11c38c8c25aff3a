"""Spectral regions: runs of high-magnitude axis points (gaps and islands)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pca import PcaModel


def high_regions(
    vectors: DataFrame, key: str, value: str, axis: np.ndarray, quantile: float = 0.97, top: int = 6
) -> DataFrame:
    """Regions of ``(key, wn, value)`` vectors where |value| reaches its own quantile.

    Neighbouring points merge when their gap is at most three typical axis steps.  Every key
    holds one axis-sized vector, so its windows are bounded by the axis.
    """
    steps = np.abs(np.diff(np.sort(np.asarray(axis, dtype=float))))
    gap = max(1e-12, 3.0 * float(np.median(steps))) if len(steps) else 3.0
    size = F.abs(F.col(value))
    per_key = Window.partitionBy(key)
    by_axis = per_key.orderBy("wn")
    high = (
        vectors.withColumn("_cut", F.percentile(size, F.lit(quantile)).over(per_key))
        .filter(size >= F.col("_cut"))
        .withColumn("_new", (F.col("wn") - F.lag("wn").over(by_axis) > gap).cast("int"))
        .withColumn("_island", F.sum(F.coalesce("_new", F.lit(0))).over(by_axis))
    )
    peak = F.max_by(F.struct("wn", value), F.struct(size, -F.col("wn")))
    regions = (
        high.groupBy(key, "_island")
        .agg(
            F.min("wn").alias("region_min"),
            F.max("wn").alias("region_max"),
            peak.alias("_peak"),
            F.max(size).alias("region_strength"),
        )
        .select(
            key,
            "region_min",
            "region_max",
            F.col("_peak.wn").alias("peak"),
            F.col(f"_peak.{value}").alias("peak_loading"),
            F.when(F.col(f"_peak.{value}") >= 0, "positive").otherwise("negative").alias("direction"),
            "region_strength",
        )
    )
    order = per_key.orderBy(F.desc("region_strength"), "region_min")
    return regions.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")


def loading_regions(model: PcaModel, spark, pcs: int = 3, quantile: float = 0.97, top: int = 6) -> DataFrame:
    """Dominant spectral regions of the leading components."""
    leading = model.loadings_table(spark).filter(F.col("PC") <= pcs)
    return high_regions(leading, "PC", "loading", model.axis, quantile, top)
