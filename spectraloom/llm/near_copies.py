"""Near copies by word-shingle similarity, found with SimHash fingerprints of 2,048 bits.

The 64 bits of ``op10_simhash`` are too coarse for a similarity of 0.8: such pairs differ by 10
bits on average and by up to 18, a radius that leaves no front of bits to part the corpus by.
This stage keeps the method's parts, with a wider fingerprint and other fronts:

* Fingerprint: every distinct shingle of ``shingle`` words is hashed to 32 words of 64 bits, and a
  bit is set if it is set in over half of the hashes.  The share of differing bits gives the angle
  between two shingle sets, and with the sets' sizes their similarity (Jaccard), with a standard
  error of about 0.02 at 0.8.  Pairs link at an estimate of ``similarity - SLACK`` or more.
* Fronts: two sets of similarity s have the same least hash with probability s.  A front is a pair
  of least hashes of different hash functions; with six fronts a pair of similarity 0.8 meets with
  probability 0.998, and a passage that fills a share f of two texts brings them together
  with f^2 only.
* Index: in each front the rows are sorted by the Gray rank of the first 64 bits; a tree
  of shared masked bits drops groups once the differences exceed ``RADIUS``, and classes that are
  already one (``simhash.search``); pairs left are compared on all bits.

Scale.  Equal shingle sets meet once.  Only ids travel to find which fronts are shared;
fingerprints follow for those alone.  Fronts of more than ``group_rows`` rows are salted,
counted and split into tiles, each pair of which is a group; groups return spanning links.

Edge cases: null and wordless texts are one class; a text of fewer words is one shingle; repeated
rows and ids are copies; of a class the smallest id stays, nulls last; an empty table stays empty.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components
from .simhash import CHUNK_ROWS, GROUP_ROWS, gray_code, gray_rank, pick, search
from .text import byte_texts, pieces

SHINGLE = 5
SIMILARITY = 0.8
#: Over one standard error of the estimate: else pairs of just the asked similarity would be lost half the time.
SLACK = 0.03
WORDS = 32
BITS = 64 * WORDS
FRONTS = 6
#: Of the first 64 bits; pairs of similarity 0.8 differ by 9.7 with a deviation of 2.9.
RADIUS = 19
SALTS = 32
#: Pairs compared on all bits at once.
PAIRS_AT_ONCE = 65_536

#: The increment and multipliers of the published SplitMix64 generator (fixed values).
STEP, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    at = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    starts = at[: max(1, len(words) - shingle + 1)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, at[min(shingle, len(words)) :])], dtype=np.uint64))


def spread_hashes(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` independent hashes of each hash, as columns."""
    x = hashes[:, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def wide_print(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint's words and the fronts of a set of shingle hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    least = np.full(WORDS, 2**64 - 1, dtype=np.uint64)
    for first in range(0, len(hashes), 255):  # so many ones fit a byte
        x = spread_hashes(hashes[first : first + 255])
        least = np.minimum(least, x.min(axis=0))
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    fp = np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)
    # the place in a front's hash keeps pairs of different functions apart
    fronts = (least[: 2 * FRONTS : 2] * np.uint64(STEP)) ^ least[1 : 2 * FRONTS : 2] ^ np.arange(FRONTS, dtype=np.uint64)
    return fp, fronts


def prints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, node, n, fp, fronts)`` per row; ``node`` names the set of shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            node, n, fp, fronts = [], [], [], []
            for text in byte_texts(batch.column(2)):
                hashes = shingle_hashes(text, shingle)
                words, heads = wide_print(hashes)
                node.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                n.append(len(hashes))
                fp.append(words.view(np.int64))
                fronts.append(heads.view(np.int64))
            columns = [pa.array(node, pa.binary()), pa.array(n, pa.int64()), listed(fp), listed(fronts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "node", "n", "fp", "fronts"]
            )

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = f"doc_id {kind}, text_hash bigint, node binary, n bigint, fp array<bigint>, fronts array<bigint>"
    return rows.mapInArrow(run, schema)


def listed(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def estimate(differing: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of two sets by their fingerprints' differing bits and their sizes."""
    shared = np.cos(np.pi * differing / BITS) * np.sqrt(n_a.astype(float) * n_b)
    return shared / np.maximum(n_a + n_b - shared, 1e-9)


def links(distinct: DataFrame, similarity: float = SIMILARITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Spanning links ``(a, b)`` of the near nodes of ``(node, n, fp, fronts)``."""
    heads = distinct.select(F.explode("fronts").alias("front"), "node")
    sizes = written(heads.groupBy("front").count().filter("count > 1"))
    hot = sizes.filter(F.col("count") > group_rows).select(
        "front",
        F.ceil(F.col("count") / (group_rows / 2)).cast("int").alias("tiles"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = heads.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    marked = written(salted.join(hot, ["front", "salt"], "left").select("front", "node", "tiles"))
    cold = sizes.filter(F.col("count") <= group_rows).select("front")
    met = marked.filter("tiles IS NOT NULL").unionByName(
        marked.filter("tiles IS NULL").join(cold, "front", "left_semi").withColumn("tiles", F.lit(1))
    )
    # a tile meets every other one; the pair of tiles is the group
    tile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    partner = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: j != F.col("tile"))
    )
    # two groups of one slot are searched as one: that costs time, and links only what is near
    slot = F.xxhash64("front", F.least("tile", "other"), F.greatest("tile", "other"))
    grouped = (
        met.join(distinct.select("node", "n", "fp"), "node")
        .withColumn("tile", tile)
        .withColumn("other", F.explode(partner))
        .select(slot.alias("slot"), "node", "n", "fp")
    )
    least = similarity - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, group in whole_slots(batches):
            a, b = near_rows(chunk, group, least)
            node = chunk.column("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])

    rows = grouped.repartition("slot").sortWithinPartitions("slot")
    return rows.mapInArrow(run, "a binary, b binary")


def whole_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by slot, cut into chunks that end where a slot ends, and the slots' first rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        slot = batch.column(0).to_numpy()
        if not len(slot):
            continue
        new = np.flatnonzero(np.append(slot[0] != last, slot[1:] != slot[:-1]))
        last = slot[-1]
        if len(new) and sum(b.num_rows for b in held) + new[-1] >= CHUNK_ROWS:
            cut = int(new[-1])
            yield one_chunk([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield one_chunk(held)


def one_chunk(held: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    chunk = pa.concat_batches(held)
    slot = chunk.column(0).to_numpy()
    return chunk, np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))


def near_rows(chunk: pa.RecordBatch, group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of each group, as row numbers of the chunk."""
    fp = chunk.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
    n = chunk.column("n").to_numpy()
    rank = gray_rank(fp[:, 0].copy())
    of_group = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(n))))
    order = np.lexsort((rank, of_group))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), dtype=bool)
        for first in range(0, len(a), PAIRS_AT_ONCE):
            x, y = order[a[first : first + PAIRS_AT_ONCE]], order[b[first : first + PAIRS_AT_ONCE]]
            differing = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64)
            keep[first : first + PAIRS_AT_ONCE] = estimate(differing, n[x], n[y]) >= least
        return keep

    return search(gray_code(rank[order]), order, group, RADIUS, near)


def rooted(docs: DataFrame, shingle: int, similarity: float, **search_settings) -> tuple[DataFrame, DataFrame]:
    """Every row's node, and ``(node, root)`` of the nodes that have links."""
    found = written(prints(docs, shingle))
    distinct = written(found.select("node", "n", "fp", "fronts").dropDuplicates(["node"]))
    return found, components(links(distinct, similarity, **search_settings))


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, **search_settings) -> DataFrame:
    """``(doc_id, root)`` per row; rows of equal roots are near copies."""
    found, roots = rooted(docs, shingle, similarity, **search_settings)
    return found.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, **search_settings) -> DataFrame:
    """One document of each class: the one with the smallest id, nulls last."""
    found, roots = rooted(docs, shingle, similarity, **search_settings)
    rows = found.groupBy("node", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "copies")
    # the best of equal sets first, so that many copies are one row when the classes are joined
    best = rows.groupBy("node").agg(F.min(order).alias("best")).join(roots, "node", "left")
    return pick(docs, best.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best")))
