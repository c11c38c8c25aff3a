"""Deterministic fold assignment: a function of keys and seed, never of row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import BUCKET_ROWS, cut_index, even_splits, hash_cuts, hash_value


def _serpentine(rank: Column, folds: int | Column) -> Column:
    """0,1,2,2,1,0,0,1,2,...: evens out group sizes dealt in descending order."""
    lap, place = F.floor(rank / folds), rank % folds
    return F.when(lap % 2 == 0, place).otherwise(folds - 1 - place).cast("int")


def row_folds(
    df: DataFrame, id_col: str, folds: int, seed: int, out: str = "fold", n: int | None = None
) -> DataFrame:
    """Shuffled K-fold of rows with sizes differing by at most one; rows are not moved."""
    salt = str(seed)
    cuts = hash_cuts(df.select(id_col), id_col, [salt], even_splits(folds), n=n).get((salt, None), [])
    return df.withColumn(out, cut_index(id_col, salt, cuts))


def stratified_row_folds(
    df: DataFrame, id_col: str, label: str, folds: int, seed: int, out: str = "fold", among: Column | None = None
) -> DataFrame:
    """Shuffled K-fold inside every class, so each fold sees every class.

    ``among`` says which rows are to be split evenly (all by default).
    """
    salt = str(seed)
    split = df if among is None else df.filter(among)
    cuts = hash_cuts(split.select(id_col, label), id_col, [salt], even_splits(folds), within=label)
    table = F.create_map(
        *[v for (_, g), c in cuts.items() for v in (F.lit(g), F.array(*[F.lit(x) for x in c]))]
    )
    mine = F.element_at(table, F.coalesce(F.col(label).cast("string"), F.lit("")))
    value = hash_value(id_col, salt)
    return df.withColumn(out, F.size(F.filter(mine, lambda c: value > c)))


def group_folds(
    groups: DataFrame,
    folds: int | Column,
    seed: int | Column,
    out: str = "fold",
    by: Sequence[str] = (),
) -> DataFrame:
    """Fold per group from a ``(group, label, rows)`` table.

    A group belongs to its most frequent class; inside each class groups are dealt to the
    folds from largest to smallest, ties in hash order.  Groups of equal size may be as many
    as there are rows, so sizes index the buckets and each bucket is ordered on its own.
    ``by`` names columns that tell several dealings apart; they are kept, and ``folds`` and ``seed``
    may be columns that depend on them.
    """
    by = list(by)
    folds, seed = (v if isinstance(v, Column) else F.lit(v) for v in (folds, seed))
    per_group = (
        groups.withColumn("_folds", folds)
        .withColumn("_seed", seed.cast("string"))
        .groupBy(*by, "group")
        .agg(
            F.sum("rows").alias("size"),
            F.max_by("label", F.struct("rows", F.col("label").cast("string"))).alias("stratum"),
            F.first("_folds").alias("_folds"),
            F.first("_seed").alias("_seed"),
        )
        .withColumn("_h", F.md5(F.concat("_seed", F.lit("|"), F.col("group"))))
    )
    n = per_group.count()
    digits = 0
    while n / 16**digits > BUCKET_ROWS:
        digits += 1
    per_group = per_group.withColumn("_p", F.substring("_h", 1, digits) if digits else F.lit(""))
    order = Window.partitionBy(*by, "stratum", "size", "_p").orderBy("_h", "group")
    # distinct (stratum, size, prefix) cells: at most sqrt(2n) sizes, so the offset table is small
    before = (
        Window.partitionBy(*by, "stratum")
        .orderBy(F.desc("size"), "_p")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        per_group.groupBy(*by, "stratum", "size", "_p")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .drop("_c")
    )
    ranked = per_group.withColumn("_r", F.row_number().over(order) - 1).join(
        offsets, [*by, "stratum", "size", "_p"]
    )
    rank = F.col("_off") + F.col("_r")
    return ranked.withColumn(out, _serpentine(rank, F.col("_folds"))).select(*by, "group", "stratum", "size", out)


def leakage(assigned: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that appear in more than one held-out fold (must be empty)."""
    return (
        assigned.groupBy(group)
        .agg(F.count_distinct(fold).alias("folds_seen"))
        .filter(F.col("folds_seen") > 1)
    )
