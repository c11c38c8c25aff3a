"""Global ranks without a single-partition window.

Ties are collapsed map-side first, values are cut into buckets of bounded size, and each
bucket only needs the count of everything before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 200_000
#: Up to so many distinct values (some 20 bytes each) the rank table is sent to every executor.
BROADCAST_VALUES = 500_000
SALTS = 16


def average_rank(
    df: DataFrame,
    value: str,
    out: str,
    bucket_rows: int = BUCKET_ROWS,
    at_most: int | None = None,
    broadcast_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """Append the 1-based tie-averaged rank of ``value`` over the whole table.

    Null values keep a null rank and don't count; NaN is above every number.  Values are cut
    into buckets by their double, which never parts equal values, and ranked in their own type.
    ``at_most`` is a known bound on the rows; when it fits one bucket no size pass is needed.
    """
    distinct = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_v").isNotNull())
    n = at_most if at_most is not None and at_most <= bucket_rows else distinct.count()
    buckets = max(1, -(-n // bucket_rows))
    doubled = distinct.withColumn("_d", F.col("_v").cast("double"))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = doubled.approxQuantile("_d", probs, 1.0 / (20 * buckets)) if probs else []
    splits = [-float("inf"), *sorted({c for c in cuts if math.isfinite(c)}), float("inf")]
    if len(splits) > 2:
        cut = Bucketizer(splits=splits, inputCol="_d", outputCol="_b", handleInvalid="keep").transform(doubled)
    else:
        cut = doubled.withColumn("_b", F.lit(0.0))
    totals = cut.groupBy("_b").agg(F.sum("_c").alias("_t"))
    # at most n / bucket_rows rows: this window and the broadcast are bounded
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(F.broadcast(offsets), "_b").select(
        "_v",
        (
            F.col("_off") + F.coalesce(F.sum("_c").over(within), F.lit(0)) + (F.col("_c") + 1) / 2
        ).cast("double").alias(out),
    )
    if n <= broadcast_values:
        return df.join(F.broadcast(ranked), df[value] == ranked["_v"], "left").drop("_v")
    # a value may be shared by many rows: its rows are salted, its rank repeated
    salted = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    spread = ranked.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    same = (salted[value] == spread["_v"]) & (salted["_s"] == spread["_t"])
    return salted.join(spread, same, "left").drop("_v", "_s", "_t")


def hash_value(key: str, salt: str) -> Column:
    """Order of rows under a seed: a function of the key alone."""
    return F.md5(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")))


def hash_cuts(
    df: DataFrame,
    key: str,
    salts: Sequence[str],
    positions: Callable[[int], Sequence[int]],
    within: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
    n: int | None = None,
) -> dict[tuple[str, str | None], list[str]]:
    """Hash values that end the first ``p`` rows of each seeded order, for ``p`` in ``positions(n)``.

    Any exact split of the rows (folds, subsamples, label blocks) is then a comparison of a
    row's own hash with a few constants: nothing but the key column is read here, and no wide
    row is shuffled there.  ``within`` (class-count sized) cuts every group on its own.
    Returns ``{(salt, group): [cut per position]}``; a cut for zero rows is the empty string.
    """
    group = F.col(within).cast("string") if within else F.lit(None).cast("string")
    hashed = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(s).alias("s"), hash_value(key, s).alias("h")) for s in salts])
        ).alias("x"),
        group.alias("g"),
    ).select("x.s", F.coalesce("g", F.lit("")).alias("g"), "x.h")
    n = df.count() if n is None else n
    digits = 0
    while n / 16**digits > bucket_rows:
        digits += 1
    prefix = F.substring("h", 1, digits) if digits else F.lit("")
    counted = hashed.groupBy("s", "g", prefix.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()
    buckets: dict[tuple[str, str], list] = {}
    for r in sorted(counted, key=lambda r: r["p"]):
        buckets.setdefault((r["s"], r["g"]), []).append((r["p"], r["c"]))
    wanted, cuts = [], {}
    for (s, g), parts in buckets.items():
        ends = list(positions(sum(c for _, c in parts)))
        cuts[(s, g)] = ["" for _ in ends]
        for j, end in enumerate(ends):
            before = 0
            for p, c in parts:
                if before < end <= before + c:
                    wanted.append((s, g, p, end - before, j))
                before += c
    if wanted:
        side = df.sparkSession.createDataFrame(wanted, "s string, g string, p string, rn int, j int")
        order = Window.partitionBy("s", "g", "p").orderBy("h")
        near = F.broadcast(side.select("s", "g", "p").distinct())
        placed = (
            hashed.withColumn("p", prefix).join(near, ["s", "g", "p"], "left_semi")
            .withColumn("rn", F.row_number().over(order))
            .join(F.broadcast(side), ["s", "g", "p", "rn"])
        )
        for r in placed.select("s", "g", "j", "h").collect():
            cuts[(r["s"], r["g"])][r["j"]] = r["h"]
    return {(s, g if within else None): c for (s, g), c in cuts.items()}


def cut_index(key: str, salt: str, cuts: Sequence[str]) -> Column:
    """Which block of the seeded order a row falls in: 0 before the first cut, and so on."""
    ends = list(cuts)
    if not ends:
        return F.lit(0)
    # the hash is bound once and compared with every cut
    passed = F.transform(
        F.array(hash_value(key, salt)), lambda h: sum(((h > F.lit(c)).cast("int") for c in ends), F.lit(0))
    )
    return F.get(passed, F.lit(0))


def even_splits(parts: int) -> Callable[[int], list[int]]:
    """Inner ends of ``parts`` blocks whose sizes differ by at most one."""
    return lambda n: [n * f // parts for f in range(1, parts)]
