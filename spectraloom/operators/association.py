"""Association screens: contingency, Cramer's V, eta squared, rank correlation, permutation p."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..spectra import ID
from .metadata import column_stats, numeric_value
from .ranks import average_rank

# Screening thresholds.
MAX_LEVELS = 30
STRONG_V, MODERATE_V = 0.80, 0.60
EFFECT_BANDS = ((0.50, "strong"), (0.25, "moderate"), (0.10, "weak"))
MIN_PRESENT = 5


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Contingency cells ``(a_name, b_name, a, b, o)`` of many column pairs in one aggregation."""
    cells = [
        F.struct(
            F.lit(a).alias("a_name"),
            F.lit(b).alias("b_name"),
            F.col(f"`{a}`").cast("string").alias("a"),
            F.col(f"`{b}`").cast("string").alias("b"),
        )
        for a, b in pairs
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("a_name", "b_name", "a", "b")
        .agg(F.count(F.lit(1)).alias("o"))
    )


def cramers_v(counts: DataFrame) -> DataFrame:
    """``(metadata_a, metadata_b, n, levels_a, levels_b, chi2, cramers_v)`` per column pair.

    Works on contingency cells only, so its windows are level-sized.  No continuity
    correction; null when either side has fewer than two levels.
    """
    pair = ["a_name", "b_name"]
    marginal = counts.withColumn("ra", F.sum("o").over(Window.partitionBy(*pair, "a"))).withColumn(
        "cb", F.sum("o").over(Window.partitionBy(*pair, "b"))
    )
    summed = marginal.groupBy(*pair).agg(
        F.sum("o").alias("n"),
        F.count_distinct("a").alias("levels_a"),
        F.count_distinct("b").alias("levels_b"),
        F.sum(F.col("o").cast("double") * F.col("o") / (F.col("ra").cast("double") * F.col("cb"))).alias("f"),
    )
    chi2 = F.greatest(F.lit(0.0), F.col("n") * (F.col("f") - 1.0))
    smaller = F.least("levels_a", "levels_b") - 1
    return summed.select(
        F.col("a_name").alias("metadata_a"),
        F.col("b_name").alias("metadata_b"),
        "n",
        "levels_a",
        "levels_b",
        F.when(smaller >= 1, chi2).alias("chi2"),
        F.when(smaller >= 1, F.sqrt(chi2 / F.col("n") / smaller)).alias("cramers_v"),
    )


def confounds(
    df: DataFrame, columns: Sequence[str], label: str | None = None
) -> tuple[pd.DataFrame, list[str]]:
    """All categorical pairs with their strength, and warnings for the strong ones."""
    names = ["metadata_a", "metadata_b", "cramers_v", "p_value", "level"]
    stats = {r["column"]: r for r in column_stats(df, columns).collect()} if columns else {}
    usable = [
        c
        for c in columns
        if 2 <= stats[c]["unique"] <= min(MAX_LEVELS, max(2, stats[c]["rows"] // 2))
    ]
    pairs = list(combinations(usable, 2))
    if not pairs:
        return pd.DataFrame(columns=names), []
    rows = cramers_v(pair_counts(df, pairs)).filter(f"n >= {MIN_PRESENT} and cramers_v is not null").collect()
    table = pd.DataFrame(
        [
            {
                "metadata_a": r["metadata_a"],
                "metadata_b": r["metadata_b"],
                "cramers_v": r["cramers_v"],
                "p_value": special.chi2_sf(r["chi2"], (r["levels_a"] - 1) * (r["levels_b"] - 1)),
                "level": _confound_level(r["cramers_v"]),
            }
            for r in rows
        ],
        columns=names,
    ).sort_values(["cramers_v", "metadata_a", "metadata_b"], ascending=[False, True, True], ignore_index=True)
    warnings = [
        f"{r.metadata_a} and {r.metadata_b} are {r.level}ly associated (Cramér's V={r.cramers_v:.2f}); "
        "an effect credited to one may partly belong to the other."
        for r in table.itertuples()
        if r.level != "low" and (label is None or label in (r.metadata_a, r.metadata_b))
    ]
    return table, warnings


def _confound_level(v: float) -> str:
    return "strong" if v >= STRONG_V else "moderate" if v >= MODERATE_V else "low"


def level_moments(df: DataFrame, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``(metadata, level, n, m_<v>, d_<v>...)``: size, mean and sum of squared deviations of each level."""
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("m"), F.col(f"`{c}`").cast("string").alias("l")) for c in columns]
        )
    ).alias("cell")
    sums = [
        agg
        for v in values
        for agg in (F.avg(v).alias(f"m_{v}"), (F.var_pop(v) * F.count(v)).alias(f"d_{v}"))
    ]
    return (
        df.select(*values, cells)
        .filter(F.col("cell.l").isNotNull())
        .groupBy(F.col("cell.m").alias("metadata"), F.col("cell.l").alias("level"))
        .agg(F.count(F.lit(1)).alias("n"), *sums)
    )


def eta_squared(df: DataFrame, columns: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``(metadata, value, n, eta_squared)``: between-level share of the total sum of squares."""
    moments = level_moments(df, columns, values)
    long = moments.select(
        "metadata",
        "n",
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"m_{v}").alias("m"), F.col(f"d_{v}").alias("d")) for v in values])
        ).alias("x"),
    ).select("metadata", "n", F.col("x.value").alias("value"), F.col("x.m").alias("m"), F.col("x.d").alias("d"))
    # one row per level: the weighted grand mean first, deviations of level means from it after
    grand = Window.partitionBy("metadata", "value")
    centred = long.withColumn("off", F.col("m") - F.sum(F.col("n") * F.col("m")).over(grand) / F.sum("n").over(grand))
    between = F.sum(F.col("n") * F.col("off") * F.col("off"))
    whole = between + F.sum("d")
    return centred.groupBy("metadata", "value").agg(
        F.sum("n").alias("n"),
        F.when(whole > 0, F.least(F.lit(1.0), between / whole)).otherwise(F.lit(0.0)).alias("eta_squared"),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(n, rho)``: Pearson correlation of globally tie-averaged ranks."""
    both = df.select(x, y).filter(
        F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    )
    ranked = average_rank(average_rank(both, x, "_rx"), y, "_ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rx", "_ry").alias("rho"))


def _rank_screen(
    df: DataFrame, complete: Sequence[str], values: Sequence[str], n: int
) -> dict[str, list[tuple[int, float]]]:
    """``(n, rho)`` per value for columns without gaps: the values are ranked once for all."""
    if not complete:
        return {}
    ranked = df.select(
        *values, *[numeric_value(F.col(f"`{c}`").cast("string")).alias(f"_x{i}") for i, c in enumerate(complete)]
    )
    for v in values:
        ranked = average_rank(ranked, v, f"_r{v}", at_most=n)
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    out = {}
    for i, c in enumerate(complete):
        row = (
            average_rank(ranked, f"_x{i}", "_rx", at_most=n)
            .agg(F.count(F.lit(1)).alias("n"), *[F.corr("_rx", f"_r{v}").alias(v) for v in values])
            .first()
        )
        out[c] = [(row["n"], row[v]) for v in values]
    ranked.unpersist()
    return out


def _eta(n: np.ndarray, s: np.ndarray, total_n: float, s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Eta squared of several values from per-level counts and sums."""
    grand = s1 * s1 / total_n
    whole = s2 - grand
    levels = (s * s / np.maximum(n, 1)[:, None]).sum(axis=0)
    return np.where(whole <= 0, 0.0, np.clip((levels - grand) / np.where(whole <= 0, 1, whole), 0, 1))


def permuted_effects(
    df: DataFrame,
    columns: Sequence[str],
    values: Sequence[str],
    permutations: int,
    seed: int,
    rows_per_bucket: int = 64,
    max_buckets: int = 4_096,
    id_col: str = ID,
) -> dict[str, np.ndarray]:
    """Null distribution of ``max eta^2`` per column under exact label permutations.

    A permutation orders the rows by a seeded hash and hands out the labels in blocks of
    their true counts.  Rows are only summed per (replicate, hash bucket) with map-side
    combine; a bucket lying inside one label block contributes its sums directly, and only
    the few buckets that straddle a block border are ordered row by row.
    """
    # deviations from the overall mean, so that sums of squares do not cancel
    means = df.agg(*[F.avg(v).alias(v) for v in values]).first()
    df = df.withColumns({v: F.col(v) - F.lit(means[v]) for v in values if means[v] is not None})
    levels = level_moments(df, columns, values).collect()
    blocks: dict[str, list] = {}
    for r in sorted(levels, key=lambda r: (r["metadata"], r["level"])):
        blocks.setdefault(r["metadata"], []).append(r)
    columns = [c for c in columns if c in blocks]
    if not columns or permutations < 1:
        return {}
    sizes = {c: sum(r["n"] for r in blocks[c]) for c in columns}
    whole = df.count()
    # columns without gaps see the same rows, so they share one set of sums (slot 0)
    gappy = [c for c in columns if sizes[c] < whole]
    slot = {c: gappy.index(c) + 1 if c in gappy else 0 for c in columns}
    buckets = int(min(max_buckets, max(1, min(whole // rows_per_bucket, 2 * math.isqrt(whole)))))
    flags = [F.col(f"`{c}`").isNotNull().alias(f"_has{i + 1}") for i, c in enumerate(gappy)]
    replicated = (
        df.select(id_col, *values, *flags, F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("rep"))
        .withColumn("_h", F.xxhash64(F.lit(seed), F.col("rep"), F.col(id_col)))
        .withColumn("bucket", F.pmod(F.shiftright("_h", 20), F.lit(buckets)).cast("int"))
    )
    aggs = [F.count(F.lit(1)).alias("n0"), *[F.sum(v).alias(f"s0_{j}") for j, v in enumerate(values)]]
    for i in range(1, len(gappy) + 1):
        aggs.append(F.count_if(f"_has{i}").alias(f"n{i}"))
        aggs += [
            F.sum(F.when(F.col(f"_has{i}"), F.col(v)).otherwise(0.0)).alias(f"s{i}_{j}")
            for j, v in enumerate(values)
        ]
    # permutations x buckets rows
    coarse = replicated.groupBy("rep", "bucket").agg(*aggs).toPandas().sort_values("bucket")
    width = len(values)
    acc = {
        (rep, i): (np.zeros(len(blocks[c])), np.zeros((len(blocks[c]), width)))
        for rep in range(permutations)
        for i, c in enumerate(columns)
    }
    border = []
    for i, c in enumerate(columns):
        ends = np.cumsum([r["n"] for r in blocks[c]])
        at = slot[c]
        for rep, part in coarse.groupby("rep"):
            n = part[f"n{at}"].to_numpy()
            stop = np.cumsum(n)
            start = stop - n
            first = np.searchsorted(ends, start, side="right")
            last = np.searchsorted(ends, np.maximum(stop - 1, start), side="right")
            sums = part[[f"s{at}_{j}" for j in range(width)]].to_numpy()
            counts, totals = acc[(int(rep), i)]
            inside = (first == last) & (n > 0)
            np.add.at(counts, first[inside], n[inside])
            np.add.at(totals, first[inside], sums[inside])
            for k in np.flatnonzero((first != last) & (n > 0)):
                border.append((int(rep), int(part["bucket"].iloc[k]), i, int(start[k]), ends.tolist()))
    if border:
        side = df.sparkSession.createDataFrame(
            border, "rep int, bucket int, col int, start bigint, ends array<bigint>"
        )
        # at most permutations x columns x MAX_LEVELS rows
        present = F.array(*[F.col(f"_has{slot[c]}") if slot[c] else F.lit(True) for c in columns])
        rows = replicated.join(F.broadcast(side), ["rep", "bucket"]).filter(F.get(present, F.col("col")))
        order = Window.partitionBy("rep", "bucket", "col").orderBy("_h", id_col)
        placed = rows.withColumn("at", F.col("start") + F.row_number().over(order) - 1).withColumn(
            "block", F.size(F.filter("ends", lambda e: e <= F.col("at")))
        )
        fine = placed.groupBy("rep", "col", "block").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"v{j}") for j, v in enumerate(values)]
        )
        for r in fine.collect():
            counts, totals = acc[(r["rep"], r["col"])]
            counts[r["block"]] += r["n"]
            totals[r["block"]] += [r[f"v{j}"] for j in range(width)]
    out = {}
    for i, c in enumerate(columns):
        s1 = np.array([sum(r["n"] * r[f"m_{v}"] for r in blocks[c]) for v in values])
        s2 = np.array([sum(r[f"d_{v}"] + r["n"] * r[f"m_{v}"] ** 2 for r in blocks[c]) for v in values])
        out[c] = np.array([_eta(*acc[(rep, i)], sizes[c], s1, s2).max() for rep in range(permutations)])
    return out


def metadata_associations(
    scored: DataFrame,
    columns: Sequence[str],
    components: int,
    cluster: str | None = None,
    permutations: int = 49,
    seed: int = 42,
    id_col: str = ID,
) -> pd.DataFrame:
    """Screen every metadata column against the leading scores and the cluster labels.

    ``scored`` has the metadata columns, ``scores`` and optionally the cluster column.  The
    p-values are descriptive: minimum / maximum over components, not corrected.
    """
    count = min(3, components)
    values = [f"_pc{j}" for j in range(count)]
    df = scored.select(
        id_col,
        *columns,
        *([cluster] if cluster else []),
        *[F.get("scores", F.lit(j)).alias(v) for j, v in enumerate(values)],
    ).persist(StorageLevel.MEMORY_AND_DISK)  # a few columns per sample, read by every screen below
    stats = {r["column"]: r for r in column_stats(df, columns).collect()} if columns else {}
    numeric, categorical = [], []
    for c in columns:
        s = stats[c]
        if s["present"] < MIN_PRESENT:
            continue
        if s["numeric"] >= 0.95 * s["present"] and s["unique"] > 5:
            numeric.append(c)
        elif 2 <= s["unique"] <= min(MAX_LEVELS, max(2, s["present"] // 2)):
            categorical.append(c)
    rows = []
    whole = {c: stats[c]["numeric"] == stats[c]["rows"] for c in numeric}
    total = max((stats[c]["rows"] for c in numeric), default=0)
    screened = _rank_screen(df, [c for c in numeric if whole[c]], values, total)
    for c in numeric:
        if not whole[c]:
            # ranks among the rows that have this value
            parsed = df.select(numeric_value(F.col(f"`{c}`").cast("string")).alias("_x"), *values)
            screened[c] = [(r["n"], r["rho"]) for r in (spearman(parsed, "_x", v).first() for v in values)]
        found = [(n, r if r is not None else math.nan) for n, r in screened[c]]
        rho = [abs(r) if math.isfinite(r) else 0.0 for _, r in found]
        p = [special.spearman_p_value(r, n) for n, r in found]
        p = [v for v in p if math.isfinite(v)]
        rows.append((c, "numeric", max(rho), min(p, default=math.nan), math.nan, math.nan))
    if categorical:
        effects: dict[str, float] = {}
        for r in eta_squared(df, categorical, values).collect():
            effects[r["metadata"]] = max(effects.get(r["metadata"], 0.0), r["eta_squared"])
        null = permuted_effects(df, categorical, values, permutations, seed, id_col=id_col)
        by_cluster = {}
        if cluster:
            pairs = [(c, cluster) for c in categorical]
            for r in cramers_v(pair_counts(df, pairs)).filter("cramers_v is not null").collect():
                dof = (r["levels_a"] - 1) * (r["levels_b"] - 1)
                by_cluster[r["metadata_a"]] = (r["cramers_v"], special.chi2_sf(r["chi2"], dof))
        for c in categorical:
            effect = effects[c]
            p = (1 + int((null[c] >= effect).sum())) / (1 + len(null[c])) if c in null else math.nan
            rows.append((c, "categorical", effect, p, *by_cluster.get(c, (math.nan, math.nan))))
    df.unpersist()
    table = pd.DataFrame(
        rows,
        columns=[
            "metadata", "type", "pca_association", "pca_p_value", "cluster_cramers_v", "cluster_p_value",
        ],
    )
    table["strength"] = [
        next((name for floor, name in EFFECT_BANDS if e >= floor), "minimal")
        for e in table["pca_association"]
    ]
    return table.sort_values(
        ["pca_association", "cluster_cramers_v"], ascending=False, na_position="last", ignore_index=True
    )
