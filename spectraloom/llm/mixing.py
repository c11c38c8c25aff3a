"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: its share by weight of ``share`` times all words, at
most ``most`` times its own, the excess going to the others by weight until none is above.
A document's expected copies are its source's target over the source's words.  Within a source the
expected copies are summed up in a fixed order, one offset is added, and a document is
emitted once for each whole number its stretch crosses; so it gets the expected copies rounded down
or up.  The order is by size, which spreads the rounding over documents of like size and brings the
words taken near the target.

Only DataFrame expressions run here.  A source is not put into one task: its rows are
dealt over (size bucket, salt) slots, ranked inside a slot, and the slots' counts are summed
up per source.  A source has at most ``64 * 64`` buckets times ``SALTS`` slots, whatever its rows.
The offset comes from a hash of the source and ``seed``, so reruns agree.

Edge cases: a null text has size 0 and is never taken; sources are ordered by code point, a null
source is a source of its own and comes last; rows with equal ids and texts are separate
documents, whose places among each other don't matter; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import BLANK, spare

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SALTS = 64
SEED = 42


def size_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, BLANK))).cast("bigint")


def size_bucket(size: Column) -> Column:
    """Sizes by their first six bits: 64 buckets in every doubling."""
    shift = F.greatest(F.length(F.bin(size)) - 6, F.lit(0))
    return (shift * 64 + F.call_function("shiftright", size, shift)).cast("int")


def hashed(bits: int, *parts: Column) -> Column:
    """The first ``bits`` bits (a multiple of four) of the MD5 of the parts, as a number."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source, so small.

    Where caps bind, the sources below theirs share in proportion to weight; ordered by cap over
    weight, the capped ones come first, and the level follows from two running sums.
    """
    # sources by code point, null last; byte order of UTF-8 is code point order
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights) + 1)
    placed = sources.withColumn("place", (F.row_number().over(ordered) - 1).cast("int")).withColumn("weight", weight)
    capped = placed.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    # the level if this source and all after it are uncapped
    level = (F.lit(share) * total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(onward)
    levels = capped.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "place", "level"))).over(everything)
    return levels.withColumn("final", final["level"]).select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, source, size, source_size, target, copies``."""
    rows = written(
        docs.select("doc_id", F.md5("text").alias("text_hash"), "source", size_of(F.col("text")).alias("size"))
        .withColumn("bucket", size_bucket(F.col("size")))
        .withColumn("salt", (hashed(32, F.col("doc_id"), F.col("text_hash")) % SALTS).cast("int"))
        .withColumn("named", F.col("source").isNotNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
    )
    slot = ["named", "source", "bucket", "salt"]
    counts = rows.groupBy(*slot).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    by_source = counts.groupBy("named", "source").agg(F.sum("words").alias("source_size"))
    goal = targets(
        by_source.select(F.when(F.col("named"), F.col("source")).alias("source"), "source_size"), weights, share, most
    ).select(
        F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("source"), "source_size", "target"
    )
    earlier = Window.partitionBy("named", "source").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(goal, ["named", "source"])
        .select(*slot, "before", "source_size", "target")
    )
    inside = Window.partitionBy(*slot).orderBy("size", "doc_id", "text_hash")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1).join(slots, slot)
    rank = F.col("before") + F.col("place")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hashed(28, F.lit(seed), F.col("source")) / F.lit(float(2**28))
    copies = F.floor((rank + 1) * rate + offset) - F.floor(rank * rate + offset)
    return ranked.select(
        "doc_id",
        "text_hash",
        F.when(F.col("named"), F.col("source")).alias("source"),
        "size",
        "source_size",
        "target",
        F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("bigint").alias("copies"),
    )


def resampled(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: every document row as often as it is taken, all columns unchanged.

    Rows with equal id and text share out their copies: such rows are told apart by nothing.
    """
    doc_id, text_hash, source, copies, rows, own, place = spare(
        docs, "mixed_id", "mixed_hash", "mixed_source", "mixed_copies", "mixed_rows", "mixed_own", "mixed_place"
    )
    taken = written(
        mixed(docs, **settings)
        .groupBy(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash), F.col("source").alias(source))
        .agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows))
        .filter(F.col(copies) > 0)
    )
    keyed = docs.withColumn(own, F.md5("text"))
    same = (
        keyed["doc_id"].eqNullSafe(F.col(doc_id))
        & (keyed[own] == F.col(text_hash))
        & keyed["source"].eqNullSafe(F.col(source))
    )
    joined = keyed.join(taken, same)
    if taken.filter(F.col(rows) > 1).limit(1).count():
        one = Window.partitionBy("doc_id", own, "source").orderBy(F.lit(1))
        repeated = joined.filter(F.col(rows) > 1).withColumn(place, F.row_number().over(one))
        joined = joined.filter(F.col(rows) == 1).unionByName(repeated.filter(F.col(place) == 1).drop(place))
    times = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(place)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], times).drop(place)
