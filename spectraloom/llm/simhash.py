"""SimHash near-duplicates found with a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint: a bit is set if it is set in over half of the hashes of the
text's word shingles.  Distinct fingerprints link at ``bits`` differing bits or fewer, and the
links' connected components are the classes.

Search.  A fingerprint is cut into ``blocks`` blocks; two that differ in at most ``bits`` bits
agree in at least ``blocks - bits`` of them.  So for every choice of that many blocks, the chosen
bits are moved to the front and the fingerprints sorted by Gray rank, which keeps equal fronts
together and, within a front, neighbours that share most bits.  Over each front stands a
tree: a node holds the bits that all its members share (mask and pattern).  A query descends
with the differences it has accumulated; once these exceed ``bits``, the node's whole group is
dropped, and so is a group whose members are already in the query's class.  The search is exact.

Scale.  A front's rows are dealt by hash; fronts with more than ``group_rows`` fingerprints
are split into tiles, of which each pair is one group, so that no task holds a hot front whole.
Groups return a spanning star of their classes, never their pairs.

Edge cases: a null or wordless text has fingerprint zero, linked like any other; repeated rows
and ids are links of a text to itself; an empty table gives an empty result; a null id is
ignored when the smallest id of a class is sought, and is that id only if all are null.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .text import byte_texts, pieces, spare

SHINGLE = 4
BITS = 4
GROUP_ROWS = 1_024
FAN = 16
#: Rows of small groups that a task searches together, and queries that descend together.
CHUNK_ROWS = 16_384
QUERIES_AT_ONCE = 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    at = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    last = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    ends = at[min(shingle, len(words)) :]
    hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(at[:last], ends)], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for part in np.array_split(hashes, math.ceil(last / 4_096)):
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += ones.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` per row, ``fp`` as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = np.array([fingerprint(t, shingle) for t in byte_texts(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_hash", "fp"]
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint")


def layouts(blocks: int, bits: int = BITS) -> list[tuple[list[int], int]]:
    """For each choice of ``blocks - bits`` blocks: the order of all bits with the chosen in front
    (most significant first), and how many these are."""
    cut = [list(x) for x in np.array_split(np.arange(63, -1, -1), blocks)]
    out = []
    for front in itertools.combinations(range(blocks), blocks - bits):
        head = [b for i in front for b in cut[i]]
        out.append((head + [b for i in range(blocks) if i not in front for b in cut[i]], len(head)))
    return out


def permuted(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """The bits of ``fp`` in the given order; runs of adjacent bits move together."""
    out, at, i = np.zeros_like(fp), 64, 0
    while i < 64:
        j = i
        while j + 1 < 64 and order[j + 1] == order[j] - 1:
            j += 1
        size = j - i + 1
        at -= size
        out |= ((fp >> np.uint64(order[j])) & np.uint64((1 << size) - 1)) << np.uint64(at)
        i = j + 1
    return out


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of a code in Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def blocks_for(n: int, bits: int = BITS) -> int:
    """More and longer fronts as the fingerprints grow, to keep a front's expected share below
    some hundreds; any choice is exact."""
    blocks = bits + 1
    while blocks < bits + 4 and n / 2 ** layouts(blocks, bits)[0][1] > 1_024:
        blocks += 1
    return blocks


def links(distinct: DataFrame, bits: int = BITS, group_rows: int = GROUP_ROWS, blocks: int | None = None) -> DataFrame:
    """Spanning links ``(a, b)`` of all pairs of distinct fingerprints ``fp`` within ``bits``."""
    plan = layouts(blocks or blocks_for(distinct.count(), bits), bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for t, (order, head) in enumerate(plan):
                rank = gray_rank(permuted(fp, order))
                front = (rank >> np.uint64(64 - head)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fp), t, np.int32)), pa.array(front), pa.array(rank.view(np.int64)), batch.column(0)],
                    ["layout", "front", "rank", "fp"],
                )

    placed = distinct.select("fp").mapInArrow(spread, "layout int, front bigint, rank bigint, fp bigint")
    sizes = placed.groupBy("layout", "front").count()
    hot = sizes.filter(F.col("count") > group_rows).select(
        "layout", "front", F.ceil(F.col("count") / (group_rows / 2)).cast("int").alias("tiles")
    )
    tiled = placed.join(hot, ["layout", "front"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # a tile meets every other one; the pair of tiles is the group
    partner = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("tile"))
    )
    grouped = tiled.withColumn("tile", tile).select(
        "layout", "front", "tile", "rank", "fp", F.explode(partner).alias("other")
    )
    keyed = grouped.select(
        F.xxhash64("layout", "front", F.least("tile", "other"), F.greatest("tile", "other")).alias("slot"),
        "layout", "front", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "rank", "fp",
    )
    key = ["slot", "layout", "front", "low", "high"]
    # rank is unsigned; within one front its first bit is the same for all
    sorted_rows = keyed.repartition("slot").sortWithinPartitions(*key, "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rank, fp, group in whole_groups(batches):
            a, b = search(gray_code(rank.view(np.uint64)), fp, group, bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return sorted_rows.select(*key, "rank", "fp").mapInArrow(run, "a bigint, b bigint")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows cut into chunks that end where a group ends: rank, fp and first row of each group."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(rest, columns)]
        new = np.zeros(len(columns[0]), dtype=bool)
        for c in columns[:5]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        if not len(cuts) or len(columns[0]) < CHUNK_ROWS:
            rest = columns
            continue
        rest = [c[cuts[-1] :] for c in columns]
        yield columns[5][: cuts[-1]], columns[6][: cuts[-1]], np.concatenate([[0], cuts[:-1]])
    if rest is not None and len(rest[0]):
        new = np.zeros(len(rest[0]), dtype=bool)
        for c in rest[:5]:
            new[1:] |= c[1:] != c[:-1]
        yield rest[5], rest[6], np.concatenate([[0], np.flatnonzero(new)])


def search(
    code: np.ndarray, fp: np.ndarray, group: np.ndarray, bits: int, near: Callable | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star links of the rows of each group, which starts at ``group`` and is in Gray order.

    ``near`` may judge the pairs of rows that are within ``bits``.
    """
    n = len(code)
    levels = tree(code, group)
    label = np.arange(n)
    group_of_query = np.repeat(np.arange(len(group)), np.diff(np.append(group, n)))
    for first in range(0, n, QUERIES_AT_ONCE):
        query = np.arange(first, min(first + QUERIES_AT_ONCE, n))
        at = levels[-1].of_group[group_of_query[query]]  # each group has one root
        differences = np.zeros(len(query), dtype=np.int64)
        fixed = np.zeros(len(query), dtype=np.uint64)  # bits that the nodes above have compared
        for depth in range(len(levels) - 1, -1, -1):
            level = levels[depth]
            own = level.mask[at]
            fresh = (level.pattern[at] ^ code[query]) & own & ~fixed
            differences = differences + np.bitwise_count(fresh)
            low = np.minimum.reduceat(label, level.start)[at]
            high = np.maximum.reduceat(label, level.start)[at]
            joined = (low == high) & (low == label[query])
            keep = (differences <= bits) & (level.end[at] > query + 1) & ~joined
            query, at, differences, fixed = query[keep], at[keep], differences[keep], own[keep]
            if depth and len(query):
                below = level.children[at]
                size = level.n_children[at]
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(below, size) + step
                query, differences, fixed = (np.repeat(x, size) for x in (query, differences, fixed))
        if near is not None:
            ok = near(query, at)
            query, at = query[ok], at[ok]
        merge(label, query, at)
    ends = np.flatnonzero(label != np.arange(n))
    return fp[ends], fp[label[ends]]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the smallest row of their class as label, in place."""
    while len(a) and (label[a] != label[b]).any():
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != label[label]).any():
            label[:] = label[label]


class Level:
    """Nodes of one level: the bits shared by all rows from start to end, and the level below."""

    def __init__(self, start, end, mask, pattern, children, n_children, of_group):
        self.start, self.end, self.mask, self.pattern = start, end, mask, pattern
        self.children, self.n_children, self.of_group = children, n_children, of_group


def tree(code: np.ndarray, group: np.ndarray) -> list[Level]:
    """Levels from the rows up to one root over each group."""
    n = len(code)
    rows = np.arange(n)
    everything = np.uint64(2**64 - 1)
    levels = [Level(rows, rows + 1, np.full(n, everything), code, rows, np.ones(n, int), group)]
    first = group  # the first node of each group on the level below
    while len(levels) == 1 or len(levels[-1].start) > len(group):
        below = levels[-1]
        count = np.diff(np.append(first, len(below.start)))
        nodes = -(-count // FAN)
        mine = np.cumsum(nodes) - nodes
        step = np.arange(nodes.sum()) - np.repeat(mine, nodes)
        children = np.repeat(first, nodes) + step * FAN
        n_children = np.minimum(FAN, np.repeat(first + count, nodes) - children)
        start = below.start[children]
        end = np.append(start[1:], n)
        every, some = np.bitwise_and.reduceat(code, start), np.bitwise_or.reduceat(code, start)
        mask = ~(every ^ some)
        levels.append(Level(start, end, mask, every & mask, children, n_children, mine))
        first = mine
    return levels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, **search_settings) -> DataFrame:
    """One row per document row: ``fp, doc_id, text_hash, root, component_id``; ``root`` names the class."""
    prints = written(fingerprints(docs, shingle))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = components(links(distinct, bits, **search_settings))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(classes, "fp")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class: the one with the smallest id, nulls last."""
    found = written(near_duplicates(docs, **settings))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    best = rows.groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "copies"), order).alias("best"))
    return pick(docs, best)


def pick(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``best`` names by ``doc_id`` and ``text_hash``, once where it has ``copies``."""
    doc_id, text_hash, copies, place = spare(docs, "kept_id", "kept_hash", "kept_copies", "kept_place")
    chosen = best.select(
        F.col("best.doc_id").alias(doc_id), F.col("best.text_hash").alias(text_hash), F.col("best.copies").alias(copies)
    )
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(F.col(doc_id)) & (F.xxhash64(docs["text"]) == F.col(text_hash)))
    single = kept.filter(F.col(copies) == 1)
    if chosen.filter(F.col(copies) > 1).limit(1).count():
        one = Window.partitionBy("doc_id", text_hash).orderBy(F.lit(1))
        repeated = kept.filter(F.col(copies) > 1).withColumn(place, F.row_number().over(one))
        single = single.unionByName(repeated.filter(F.col(place) == 1).drop(place))
    return single.select(*[F.col(f"`{c}`") for c in docs.columns])
