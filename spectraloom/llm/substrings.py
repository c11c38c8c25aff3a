"""Substring dedup with prefix-partitioned, truncated suffix trees.

A word goes if a window of ``window`` words that covers it occurs anywhere else too.  The windows
are the suffixes of the texts cut to ``window`` words, so those that occur twice are the leaves
below the deep nodes of a truncated suffix tree.

Which suffixes.  Almost all windows occur once, and a suffix costs far more than its place, so
suffixes are first tested by a short prefix.  Each window holds one anchor: of its
``window - gram + 1`` runs of ``gram`` words, the first with the smallest hash.  Equal windows have
equal anchors at the same place.  Anchors whose run of words occurs once in the corpus have only
single windows; those of the rest form the groups.

Groups.  Suffixes are parted by the anchor's words, the short prefix.  An anchor seen more than
``group_rows`` times would make too large a group: its suffixes are parted by all of their words
instead, the longest prefix there is, at which a group is a node and only needs counting, which
Spark does before it shuffles.  Every other group fits a task.  Only suffixes that have the anchor at
the same offset can be equal, so each offset makes a subtree of its own: the sorted
suffixes with the word lengths of their common prefixes, its deep nodes being the runs of
neighbours that share ``window`` words.

Texts travel once, to meet their repeated anchors; after that only documents that have some.

Edge cases: a null text has no words; texts shorter than the window keep all words; of rows with
equal id and text each counts as an occurrence, so they lose all windows; overlapping occurrences
count; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import byte_texts, pieces

WINDOW = 35
GRAM = 12
#: Rows of a group; with their word places and the leaves of one offset some kilobyte each.
GROUP_ROWS = 32_768
#: Rows of one Arrow batch given back.
OUT_ROWS = 8_192
KEY = ["doc_id", "text_hash"]
#: Bits of a number that hold a word's place; a text of 2^31 bytes has no more words.
PLACE = np.uint64((1 << 30) - 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def anchors(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window, and the hash of the run of words at each place."""
    if len(words) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes, runs = word_hashes(words), np.zeros(len(words) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j : len(runs) + j]
    runs ^= runs >> np.uint64(31)
    # the leading bits of the hash, then the place: the least of a window is its first place of least hash
    least, span, wide = (runs & ~PLACE) | np.arange(len(runs), dtype=np.uint64), window - gram + 1, 1
    while 2 * wide <= span:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < span:
        least = np.minimum(least[: wide - span], least[span - wide :])
    return (least & PLACE).astype(np.int64), runs


def places(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``(doc_id, text_hash, run, at, first, last)`` of all anchors; their windows begin at words ``first`` to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows, runs, at, firsts, lasts = [], [], [], [], []
            for i, text in enumerate(byte_texts(batch.column(2))):
                anchor, hashes = anchors((text or b"").split(), window, gram)
                # anchors never move back from one window to the next
                first = np.flatnonzero(np.diff(anchor, prepend=-1))
                rows.append(np.full(len(first), i))
                runs.append(hashes[anchor[first]])
                at.append(anchor[first])
                firsts.append(first)
                lasts.append(np.append(first[1:], len(anchor))[: len(first)] - 1)
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    batch.column(1).take(row),
                    pa.array(np.concatenate(runs).view(np.int64)),
                    *(pa.array(np.concatenate(x).astype(np.int32)) for x in (at, firsts, lasts)),
                ],
                [*KEY, "run", "at", "first", "last"],
            )

    return docs.mapInArrow(run, f"{key_types(docs)}, run bigint, at int, first int, last int")


def key_types(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash bigint"


def suffix_rows(candidates: DataFrame, window: int, hot: bool) -> DataFrame:
    """One row per repeated anchor of a document, of the frequent ones or of the others: its windows begin at words ``first`` to
    ``last``, and ``words`` is the text from the first window's begin to the last one's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            sizes = pc.list_value_length(batch.column(3)).to_numpy()
            at, first, last, runs = batch.column(3).flatten().flatten()[:4]
            rows = np.repeat(np.arange(len(sizes)), sizes)
            starts, ends = iter(first.to_pylist()), iter(last.to_pylist())
            texts = []
            for text, size in zip(byte_texts(batch.column(2)), sizes.tolist()):
                words = text.split()
                texts += [b" ".join(words[a : b + window]) for a, b in zip(itertools.islice(starts, size), itertools.islice(ends, size))]
            for part in range(0, len(rows), OUT_ROWS):
                row = pa.array(rows[part : part + OUT_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        *(c.slice(part, OUT_ROWS) for c in (runs, at, first, last)),
                        pa.array(texts[part : part + OUT_ROWS], pa.binary()),
                    ],
                    [*KEY, "run", "at", "first", "last", "words"],
                )

    wanted = F.filter("anchors", lambda x: x["hot"] == hot)
    chosen = candidates.select(*KEY, "text", wanted.alias("anchors")).filter(F.size("anchors") > 0)
    return chosen.mapInArrow(run, f"{key_types(candidates)}, run bigint, at int, first int, last int, words binary")


def word_starts(words: bytes) -> array:
    """Where the words joined by spaces begin, and one past the end and its space."""
    return array("I", [0, *itertools.accumulate(len(w) + 1 for w in words.split(b" "))])


def suffixes(words: bytes, count: int, window: int) -> list[bytes]:
    """The first ``count`` suffixes, cut to the window."""
    at = word_starts(words)
    return [words[at[j] : at[j + window] - 1] for j in range(count)]


def common_words(a: bytes, b: bytes) -> int:
    """Length in words of the common prefix of two suffixes."""
    if a == b:
        return a.count(b" ") + 1
    n = 0
    for x, y in zip(a.split(), b.split()):
        if x != y:
            break
        n += 1
    return n


def deep_leaves(leaves: list[tuple[bytes, int]], window: int) -> list[int]:
    """The rows of all suffixes below a node at least ``window`` words deep.

    ``leaves`` are (suffix, row); sorted, they are the subtree's leaves in order, and the common
    prefixes of neighbours are the depths of its inner nodes.
    """
    leaves.sort()
    deep = [a[0] == b[0] or common_words(a[0], b[0]) >= window for a, b in itertools.pairwise(leaves)]
    return [row for (_, row), before, after in zip(leaves, [False, *deep], [*deep, False]) if before or after]


def group_repeats(rows: DataFrame, window: int) -> DataFrame:
    """``(doc_id, text_hash, start, end)`` of repeated stretches, one subtree per anchor."""

    def subtree(rows: list[tuple], out: list[tuple]) -> None:
        if len(rows) < 2:
            return
        cuts = [word_starts(words) for *_, words in rows]
        marked: dict[int, list[int]] = {}
        for offset in range(max(at - first for _, _, at, first, _, _ in rows) + 1):
            leaves = [
                (words[cuts[i][j] : cuts[i][j + window] - 1], i)
                for i, (_, _, at, first, last, words) in enumerate(rows)
                if 0 <= (j := at - offset - first) <= last - first
            ]
            if len(leaves) > 1:
                for i in deep_leaves(leaves, window):
                    marked.setdefault(i, []).append(rows[i][2] - offset)
        for i, starts in marked.items():
            out.extend((*rows[i][:2], a, b + window) for a, b in stretches(sorted(starts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows, out = None, [], []
        for batch in batches:
            for run_, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if run_ != name:
                    subtree(rows, out)
                    name, rows = run_, []
                    if len(out) >= OUT_ROWS:
                        yield spans_batch(out, kind)
                        out = []
                rows.append(row)
        subtree(rows, out)
        yield spans_batch(out, kind)

    kind = rows.schema["doc_id"].dataType.simpleString()
    parted = rows.select("run", *KEY, "at", "first", "last", "words").repartition("run")
    return parted.sortWithinPartitions("run").mapInArrow(run, f"{key_types(rows)}, start int, end int")


def stretches(at: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of adjacent numbers."""
    out: list[tuple[int, int]] = []
    for x in at:
        if out and out[-1][1] >= x - 1:
            out[-1] = (out[-1][0], x)
        else:
            out.append((x, x))
    return out


def spans_batch(spans: list[tuple], kind: str) -> pa.RecordBatch:
    ids, hashes, start, end = zip(*spans) if spans else ((), (), (), ())
    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), pa.array(hashes, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
        [*KEY, "start", "end"],
    )


def hot_repeats(rows: DataFrame, window: int) -> DataFrame:
    """The same for frequent anchors: suffixes parted by all their words, nodes counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            row, start, node = [], [], []
            for i, (first, last, words) in enumerate(zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)])):
                for j, suffix in enumerate(suffixes(words, last - first + 1, window)):
                    row.append(i)
                    start.append(first + j)
                    node.append(hashlib.blake2b(suffix, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    batch.column(1).take(pa.array(row, pa.int64())),
                    pa.array(start, pa.int32()),
                    pa.array(node, pa.binary()),
                ],
                [*KEY, "start", "node"],
            )

    leaves = written(rows.select(*KEY, "first", "last", "words").mapInArrow(run, f"{key_types(rows)}, start int, node binary"))
    deep = leaves.groupBy("node").count().filter("count > 1").select("node")
    return leaves.join(deep, "node", "left_semi").select(*KEY, "start", (F.col("start") + window).alias("end"))


def removals(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group_rows: int = GROUP_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents keyed, those with repeated anchors, and the stretches of words to remove."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    anchor = written(places(keyed, window, gram))
    # as a table of its own, so that a frequent anchor's rows can be split in the join
    repeated = written(
        anchor.groupBy("run").count().filter("count > 1").select("run", (F.col("count") > group_rows).alias("hot"))
    )
    found = (
        anchor.join(repeated, "run")
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.struct("at", "first", "last", "run", "hot"))).alias("anchors"))
    )
    k, f = keyed.alias("k"), found.alias("f")
    candidates = written(
        k.join(f, F.expr("k.doc_id <=> f.doc_id and k.text_hash = f.text_hash")).select(
            "k.doc_id", "k.text_hash", "text", "anchors"
        )
    )
    spans = group_repeats(suffix_rows(candidates, window, False), window)
    if repeated_hot(candidates):
        spans = spans.unionByName(hot_repeats(suffix_rows(candidates, window, True), window))
    return keyed, candidates, spans


def repeated_hot(candidates: DataFrame) -> bool:
    return candidates.filter(F.exists("anchors", lambda x: x["hot"])).limit(1).count() > 0


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, n_words, n_removed, kept_sha256``."""
    keyed, candidates, spans = removals(docs, **settings)
    by_doc = spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    c, s = candidates.dropDuplicates(KEY).alias("c"), by_doc.alias("s")
    touched = c.join(s, F.expr("c.doc_id <=> s.doc_id and c.text_hash = s.text_hash")).select(
        "c.doc_id", "c.text_hash", "text", "spans"
    )
    cut = touched.mapInArrow(_cut, f"{key_types(keyed)}, n_removed bigint, kept_sha256 string")
    whole = keyed.mapInArrow(_whole, f"{key_types(keyed)}, n_words bigint, all_sha256 string")
    w, t = whole.alias("w"), cut.alias("t")
    return w.join(t, F.expr("w.doc_id <=> t.doc_id and w.text_hash = t.text_hash"), "left").select(
        "w.doc_id",
        "w.text_hash",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"),
    )


def kept_words(text: bytes | None, spans: list[dict]) -> list[bytes]:
    words = (text or b"").split()
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(gone, [s["start"] for s in spans], 1)
    np.add.at(gone, [s["end"] for s in spans], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 64):
        texts, spans = byte_texts(batch.column(2)), batch.column(3).to_pylist()
        kept = [kept_words(t, s) for t, s in zip(texts, spans)]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array([len(t.split()) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]),
            ],
            [*KEY, "n_removed", "kept_sha256"],
        )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 64):
        words = [(t or b"").split() for t in byte_texts(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array(list(map(len, words)), pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words]),
            ],
            [*KEY, "n_words", "all_sha256"],
        )
