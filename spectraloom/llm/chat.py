"""Conversations from reply trees, as marked and escaped chat text with a loss mask.

Messages form trees by ``parent``.  Root-to-leaf paths are enumerated by self-joins of the message
table: each round doubles the distance of an ancestor table (the message 2^j steps up), and
then, from the longest distance down, every known (leaf, ancestor) pair yields the pair 2^j further
up.  So a path of n messages takes 2 log n joins on unique message ids, whatever its
length, and no join key is shared by many rows.  Paths of a tree are ranked by score and the best
``top`` are formatted, each as one conversation.

Format.  A message is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside texts a backslash becomes two and
``<|`` becomes ``<\\|``, so no control string can occur there, and dropping the backslash before any
character undoes it; roles are URL-encoded, which leaves plain names as they are.  The loss mask is
a list of byte ranges of the formatted UTF-8 text, one for each assistant text.

Only DataFrame expressions run here.  One conversation's messages meet in one row at the end, as
the format demands; everything before works on single messages.

Edge cases: a null text is empty, a null role is the empty role; a message whose parent is null or
absent is a root; of messages with equal id one is kept, the smallest by parent, role and text;
a message that is its own ancestor belongs to no path and is left out; equal scores go by
leaf id.  ``thread`` makes a chain of rows of a conversation by (turn, role, text), nulls
first; rows equal in all of them are separate turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS_PER_SLOT = 64


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def thread(rows: DataFrame) -> DataFrame:
    """Linear conversations ``conv_id, turn, role, text`` as messages ``tree, node, parent, role, text, score``.

    A row's predecessor is the one before it in its slot of turns, or the last of the slot before;
    so a very long conversation is spread over many tasks.
    """
    slot = F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_SLOT)
    placed = rows.select(
        F.col("conv_id").alias("tree"),
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("turn").isNull(), F.lit(None)).otherwise(slot).alias("slot"),
    )
    inside = Window.partitionBy("tree", "slot").orderBy("turn", "role", "text")
    numbered = placed.withColumn("n", F.row_number().over(inside))
    sizes = numbered.groupBy("tree", "slot").agg(F.max("n").alias("size"))
    earlier = Window.partitionBy("tree").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        F.col("tree").alias("t"), F.col("slot").alias("s"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    )
    joined = numbered.join(before, F.col("tree").eqNullSafe(F.col("t")) & F.col("slot").eqNullSafe(F.col("s")))
    place = (F.col("before") + F.col("n")).cast("bigint")
    return joined.select(
        "tree",
        F.struct("tree", place.alias("n")).alias("node"),
        F.when(place > 1, F.struct("tree", (place - 1).alias("n"))).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``tree, leaf, node, up`` of the best ``top`` root-to-leaf paths of every tree; ``up`` counts from the leaf."""
    best = messages.groupBy("node").agg(F.min(F.struct("tree", "parent", "score")).alias("m")).select("node", "m.*")
    known = written(best)
    parents = known.select(F.col("node").alias("below"), F.col("parent").alias("node")).filter("node IS NOT NULL")
    edges = written(parents.join(known.select("node"), "node").select("below", F.col("node").alias("above")))
    leaves = known.join(edges.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
    jumps, n = [], known.count()
    while 2 ** len(jumps) <= n and edges.limit(1).count():
        jumps.append(edges)
        longer = edges.join(edges.select(F.col("below").alias("above"), F.col("above").alias("next")), "above")
        edges = written(longer.select("below", F.col("next").alias("above")))
    # what still has an ancestor further up than there are messages leads into a ring
    leaves = leaves.join(edges.select(F.col("below").alias("node")), "node", "left_anti")
    ranked = Window.partitionBy("tree").orderBy(F.col("score").desc_nulls_last(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    found = chosen.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for j in range(len(jumps) - 1, -1, -1):
        step = jumps[j].select(F.col("below").alias("node"), "above")
        both = F.array(
            F.struct("node", "up"), F.struct(F.col("above").alias("node"), (F.col("up") + 2**j).alias("up"))
        )
        found = found.join(step, "node", "left").select("tree", "leaf", F.explode(both).alias("at"))
        found = found.select("tree", "leaf", "at.node", "at.up").filter("node IS NOT NULL")
    return found


def formatted(messages: DataFrame, top: int = 1, learn: str = "assistant") -> DataFrame:
    """``tree, leaf, chat, mask``: one formatted conversation per chosen path, and its loss mask."""
    one = messages.groupBy("node").agg(F.min(F.struct("parent", "role", "text")).alias("m"))
    said = one.select("node", F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    body = escaped(F.col("text"))
    pieces = (
        paths(messages, top)
        .join(said, "node")
        .select(
            "tree",
            "leaf",
            (-F.col("up")).alias("place"),
            F.concat(head, body, F.lit(CLOSE + "\n")).alias("piece"),
            F.octet_length(head).alias("skip"),
            F.octet_length(body).alias("size"),
            (F.col("role") == learn).alias("learn"),
        )
    )
    order = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn(
        "start", F.coalesce(F.sum(F.octet_length("piece").cast("bigint")).over(order), F.lit(0)) + F.col("skip")
    )
    gathered = placed.groupBy("tree", "leaf").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", "start", "size", "learn"))).alias("all")
    )
    return gathered.select(
        "tree",
        "leaf",
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("chat"),
        F.transform(
            F.filter("all", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"))
        ).alias("mask"),
    )


def turns_of(chat: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.split(chat, r"<\|im_end\|>\n")
    whole = F.filter(parts, lambda p: p.startswith(OPEN))
    bare = F.transform(whole, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(
        bare,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"),
            unescaped(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"),
        ),
    )


def learned_text(chat: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    data = F.encode(chat, "UTF-8")
    parts = F.transform(
        mask, lambda m: F.decode(F.substring(data, (m["start"] + 1).cast("int"), m["size"].cast("int")), "UTF-8")
    )
    return unescaped(F.array_join(parts, ""))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, all read back from ``chat`` and ``mask``."""
    read = chats.withColumns(
        {"turns": turns_of(F.col("chat")), "learned": learned_text(F.col("chat"), F.col("mask"))}
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "tree",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("chat").cast("bigint").alias("formatted_chars"),
    )
