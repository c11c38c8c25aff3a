"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of slots, and a versioned map says which shard a slot
belongs to.  The first version deals equal ranges of slots; rebalancing aggregates the bytes of every
slot, takes the smallest slots off the shards above the level and gives them, largest first, to the
shard that has least, and stores the edited map as the next version.  A lookup needs a record's hash
and the map only.  ``grown`` adds a shard the same way: slots move to the new shard and nowhere else.

Only DataFrame expressions run here.  The map is as large as the number of slots, not as the data;
rows meet in groups of (slot, part), where a part is a hash of the row and its place in the scan, so that
even a third of all rows being one repeated row is dealt over ``PARTS`` groups in every slot.  A slot heavier than
``1 / HEAVY`` of a shard is listed in the map by its parts, which then move by themselves.

The law that holds is ``bytes``: shards differ by about one small slot, unless a single record is
larger than that.

Edge cases: a null text has no bytes (size 1, like an empty one); a null id is hashed by its text;
repeated rows are separate records with places of their own; an empty table has a map and no rows;
other columns are not read; a record larger than a shard's level stays alone where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

SHARDS = 16
SLOTS = 4096
PARTS = 16
HEAVY = 32
#: The part that stands for a whole slot in the map.
WHOLE = -1


def slot_of(doc_id: Column, text: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, text), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS, parts: int = PARTS) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, part`` of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("vslot"),
        F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"),
    )


def weights(rows: DataFrame) -> DataFrame:
    """``vslot, part, bytes, n`` of the slots' parts that have rows."""
    return rows.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: equal ranges of slots, whatever the data."""
    return spark.range(slots).select(
        F.lit(1).alias("version"),
        F.col("id").cast("int").alias("vslot"),
        F.lit(WHOLE).alias("part"),
        F.floor(F.col("id") * shards / slots).cast("int").alias("shard"),
    )


def units(slot_map: DataFrame, weight: DataFrame, shards: int, heavy: int = HEAVY) -> DataFrame:
    """``vslot, part, shard, bytes`` of what the newest map can move: slots, and the parts of heavy slots."""
    total = weight.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"))
    slot = weight.groupBy("vslot").agg(F.sum("bytes").alias("slot_bytes"))
    bound = F.col("slot_bytes") * (heavy * shards) > F.col("total")
    # one row of totals, and the map is as small as the number of slots
    sized = weight.join(F.broadcast(slot), "vslot").join(F.broadcast(total))
    split = sized.withColumn("part", F.when(bound, F.col("part")).otherwise(F.lit(WHOLE)))
    loads = split.groupBy("vslot", "part").agg(F.sum("bytes").alias("bytes"))
    whole = slot_map.filter(F.col("part") == WHOLE).select("vslot", F.col("shard").alias("home"))
    own = slot_map.filter(F.col("part") != WHOLE).select("vslot", "part", F.col("shard").alias("own"))
    slots = slot_map.select("vslot").distinct()
    placed = slots.join(loads, "vslot", "left").withColumn("part", F.coalesce("part", F.lit(WHOLE)))
    return (
        placed.join(whole, "vslot", "left")
        .join(own, ["vslot", "part"], "left")
        # a slot that was split and is light again goes home to its first shard
        .join(own.groupBy("vslot").agg(F.min("own").alias("first")), "vslot", "left")
        .select("vslot", "part", F.coalesce("own", "home", "first").alias("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    )


def _leaving(unit: DataFrame, shards: int) -> DataFrame:
    """Marks the units that leave their shard: its smallest, beyond the level that all could have."""
    mean = F.sum("bytes").over(Window.partitionBy()) / shards
    giant = F.col("bytes") > mean
    giants = F.count(F.when(giant, 1)).over(Window.partitionBy())
    others = F.sum(F.when(giant, 0).otherwise(F.col("bytes"))).over(Window.partitionBy())
    level = F.when(giants < shards, others / (shards - giants)).otherwise(mean)
    down = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot", "part")
    kept = F.sum("bytes").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sized = unit.withColumn("level", level).withColumn("first", F.row_number().over(down) == 1)
    return sized.withColumn("leaves", (kept > F.col("level")) & ~F.col("first") & (F.col("bytes") > 0))


def rebalanced(slot_map: DataFrame, weight: DataFrame, shards: int = SHARDS, heavy: int = HEAVY) -> DataFrame:
    """The next version of the map: what leaves goes, largest first, to the shard with the fewest bytes."""
    newest = _newest(slot_map)
    marked = written(_leaving(units(newest, weight, shards, heavy), shards))
    # bounded by the number of slots and of parts of heavy slots, not by the rows
    one = marked.agg(
        F.array_sort(
            F.collect_list(F.when(F.col("leaves"), F.struct((-F.col("bytes")).alias("less"), "vslot", "part")))
        ).alias("moving"),
        *[F.sum(F.when((F.col("shard") == s) & ~F.col("leaves"), F.col("bytes")).otherwise(0)).alias(f"load{s}") for s in range(shards)],
    )
    loads = F.array(*[F.struct(F.coalesce(F.col(f"load{s}"), F.lit(0)).alias("bytes"), F.lit(s).alias("shard")) for s in range(shards)])
    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("to"))

    def place(state: Column, unit: Column) -> Column:
        least = F.array_min(state["loads"])
        filled = F.transform(
            state["loads"],
            lambda x: F.when(
                x["shard"] == least["shard"], F.struct((x["bytes"] - unit["less"]).alias("bytes"), x["shard"].alias("shard"))
            ).otherwise(x),
        )
        return F.struct(filled.alias("loads"), F.array_append(state["to"], least["shard"]).alias("to"))

    dealt = one.withColumn("end", F.aggregate("moving", start, place)).select(
        F.explode(F.arrays_zip("moving", F.col("end.to").alias("to"))).alias("m")
    )
    moved = dealt.select("m.moving.vslot", "m.moving.part", F.col("m.to").alias("to"))
    version = newest.agg(F.max("version").alias("version"))
    return (
        marked.join(F.broadcast(moved), ["vslot", "part"], "left")
        .join(F.broadcast(version))
        .select((F.col("version") + 1).alias("version"), "vslot", "part", F.coalesce("to", "shard").alias("shard"))
    )


def grown(slot_map: DataFrame, weight: DataFrame, shards: int, heavy: int = HEAVY) -> DataFrame:
    """The next version with one more shard, numbered ``shards``: every shard gives its smallest slots to it."""
    newest = _newest(slot_map)
    unit = units(newest, weight, shards, heavy)
    share = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    up = Window.partitionBy("shard").orderBy("bytes", "vslot", "part")
    given = F.sum("bytes").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("bytes").over(Window.partitionBy("shard"))
    moves = (F.col("bytes") > 0) & (given <= own - F.col("share"))
    version = newest.agg(F.max("version").alias("version"))
    return (
        unit.withColumn("share", share)
        .withColumn("moves", moves)
        .join(F.broadcast(version))
        .select((F.col("version") + 1).alias("version"), "vslot", "part", F.when(F.col("moves"), F.lit(shards)).otherwise(F.col("shard")).alias("shard"))
    )


def _newest(slot_map: DataFrame) -> DataFrame:
    last = slot_map.agg(F.max("version").alias("last"))
    return slot_map.join(F.broadcast(last)).filter("version = last").drop("last")


def versions(spark: SparkSession, weight: DataFrame, shards: int = SHARDS, slots: int = SLOTS, heavy: int = HEAVY) -> DataFrame:
    """The stored map ``version, vslot, part, shard``: the first version and the rebalanced one."""
    first = first_map(spark, shards, slots)
    return written(first.unionByName(rebalanced(first, weight, shards, heavy)))


def sharded(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, parts: int = PARTS, heavy: int = HEAVY) -> DataFrame:
    """One row per document row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version``.

    ``slot`` is the row's place in its shard, from 0 without gaps: places of the (slot, part) groups come from
    their counts, and rows are ranked inside a group only.
    """
    rows = written(records(docs, slots, parts))
    weight = written(weights(rows))
    slot_map = _newest(versions(docs.sparkSession, weight, shards, slots, heavy))
    whole = slot_map.filter(F.col("part") == WHOLE).select("vslot", "version", F.col("shard").alias("home"))
    own = slot_map.filter(F.col("part") != WHOLE).select("vslot", "part", F.col("version").alias("own_version"), F.col("shard").alias("own"))
    located = weight.join(F.broadcast(whole), "vslot", "left").join(F.broadcast(own), ["vslot", "part"], "left")
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    groups = located.select(
        "vslot", "part", "n", F.coalesce("own", "home").alias("shard"), F.coalesce("own_version", "version").alias("version")
    ).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1)
    # as many rows as slots and parts at most
    placed = ranked.join(F.broadcast(groups.drop("n")), ["vslot", "part"])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("place")).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
        F.col("version").alias("map_version"),
    )
