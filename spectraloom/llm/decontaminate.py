"""Benchmark decontamination by winnowing.

A text and an item that share a span of ``window`` words share, inside that span, the smallest
hash of its k-grams.  So each text keeps one hash per sliding window (its fingerprints), the
fingerprints meet those of the items in a join, and every meeting is extended to the run of windows
that share the fingerprint, which are compared as whole word sequences.  Nothing shared by ``window`` words or
more can be missed, and nothing is reported that isn't equal word by word.

Only DataFrame expressions run here.  A document's words stay in its own row: the join is a
probe of each fingerprint, and probes that meet carry on the words of their own windows only, so
cost and memory are in proportion to a text's length, however much of it is contaminated.

Edge cases: a null or wordless text has no words and no hits; an item with fewer words than the
window is one window of its own length; a wordless item is ignored; an item without id counts
under the empty name; repeated rows each get their own, equal result; an empty benchmark leaves
all documents clean; other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .text import alnum_words, spare

WINDOW = 13
GRAM = 5
#: Up to so many rows (some 100 bytes each) the items' side of a join is sent to every executor.
BROADCAST_ROWS = 200_000
SALTS = 16


def gram_hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def starts(words: Column, length: int) -> Column:
    """Starts of all windows of ``length`` words."""
    return F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(
        F.array().cast("array<int>")
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """``(length, gram, window_text, item)``: each distinct window of each item with its fingerprint."""
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(F.col("text")).alias("words")
    )
    sized = words.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    each = sized.select(
        "item", "length", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("start")
    )
    cut = each.select("item", "length", F.expr("slice(words, start + 1, length)").alias("words"))
    width = F.least(F.col("length"), F.lit(k))
    hashes = F.transform(
        F.sequence(F.lit(0), F.col("length") - width),
        # a gram past the end of a short window hashes the words that are there, as in the documents
        lambda i: F.when(F.col("length") >= k, gram_hash(F.col("words"), i, k)).otherwise(
            F.xxhash64(*[F.get("words", F.lit(j)) for j in range(k)])
        ),
    )
    return cut.select(
        "length", F.array_min(hashes).alias("gram"), F.array_join("words", " ").alias("window_text"), "item"
    ).distinct()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprints(words: Column, length: int, k: int) -> Column:
    """Runs of windows of ``length`` words that have one smallest gram hash: ``(gram, start, end)``, windows start to end - 1."""
    width = max(1, length - k + 1)

    def smallest(hashes: Column) -> Column:
        return F.transform(
            starts(words, length),
            lambda i: F.least(*[F.get(hashes, i + j) for j in range(width)]) if width > 1 else F.get(hashes, i),
        )

    def runs(prints: Column) -> Column:
        first = F.filter(
            F.sequence(F.lit(0), F.size(prints) - 1), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1))
        )
        ended = let(
            first,
            lambda at: F.zip_with(
                at,
                F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(prints))),
                lambda s, e: F.struct(F.get(prints, s).alias("gram"), s.alias("start"), e.alias("end")),
            ),
        )
        return F.when(F.size(prints) > 0, ended)

    hashes = F.transform(starts(words, k), lambda i: gram_hash(words, i, k))
    return let(let(hashes, smallest), runs)


def _meetings(docs: DataFrame, items: DataFrame, length: int, k: int, broadcast_rows: int) -> DataFrame:
    """``(doc_id, text_hash, start, window_text)`` of the document windows whose fingerprint is met.

    A window equal to an item's has its fingerprint, so no other windows need a look; of a text's words only those
    of its met windows go on.
    """
    k = min(k, length)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), alnum_words(F.col("text")).alias("words"))
    looked = keyed.select("doc_id", "text_hash", "words", F.explode(fingerprints(F.col("words"), length, k)).alias("run"))
    wanted = items.filter(F.col("length") == length).select("gram").distinct()
    if items.count() <= broadcast_rows:
        met = looked.select("doc_id", "text_hash", "words", "run.*").join(F.broadcast(wanted), "gram", "left_semi")
    else:
        # the words stay behind; only fingerprints travel, those of frequent passages salted
        salted = keyed_salt(looked.select("doc_id", "text_hash", "run.*"))
        pairs = salted.join(spread(wanted), ["gram", "salt"], "left_semi")
        found = pairs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("met"))
        met = (
            keyed.alias("d")
            .join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.text_hash = f.text_hash"))
            .select("d.doc_id", "d.text_hash", "words", F.inline("met"))
        )
    cut = met.select(
        "doc_id", "text_hash", "start", F.slice("words", F.col("start") + 1, F.col("end") - F.col("start") + length - 1).alias("words")
    )
    windows = F.transform(
        starts(F.col("words"), length), lambda i: F.struct(i.alias("at"), F.array_join(F.slice("words", i + 1, F.lit(length)), " ").alias("window_text"))
    )
    return cut.select("doc_id", "text_hash", "start", F.inline(windows)).select(
        "doc_id", "text_hash", (F.col("start") + F.col("at")).alias("start"), F.lit(length).alias("length"), "window_text"
    )


def keyed_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)))


def spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    k: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document row: ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_hit`` counts the words inside any occurrence of an item's window; a document is
    contaminated when these are 5 % of its words or more.
    """
    items = written(item_windows(benchmark, window, k))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # at most ``window`` numbers
    found = None
    for length in lengths:
        rows = _meetings(docs, items, length, k, broadcast_rows)
        found = rows if found is None else found.unionByName(rows)
    totals = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.size(alnum_words(F.col("text"))).cast("bigint").alias("n_words")
    )
    if found is None:
        hits = docs.sparkSession.createDataFrame(
            [], "doc_id bigint, text_hash bigint, n_hit bigint, n_items bigint, items_sha256 string"
        )
    else:
        known = items.select("length", "window_text").distinct()
        if items.count() <= broadcast_rows:
            equal = found.join(F.broadcast(known), ["length", "window_text"], "left_semi")
        else:
            equal = keyed_salt(found).join(spread(known), ["length", "window_text", "salt"], "left_semi").drop("salt")
        equal = written(equal.distinct())
        hits = _covered(equal).join(_items(equal, items), ["doc_key"]).select("doc_key.*", "n_hit", "n_items", "items_sha256")
    none = F.sha2(F.lit(""), 256)
    t, h = totals.alias("t"), hits.alias("h")
    return t.join(h, F.expr("t.doc_id <=> h.doc_id and t.text_hash = h.text_hash"), "left").select(
        "t.doc_id",
        "t.text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"),
        F.coalesce((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


def _covered(equal: DataFrame) -> DataFrame:
    """Words inside the union of a document's equal windows."""
    by_doc = Window.partitionBy("doc_key").orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = equal.select(
        F.struct("doc_id", "text_hash").alias("doc_key"), "start", (F.col("start") + F.col("length")).alias("end")
    ).distinct()
    fresh = spans.withColumn(
        "fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    )
    return fresh.groupBy("doc_key").agg(F.sum("fresh").alias("n_hit"))


def _items(equal: DataFrame, items: DataFrame) -> DataFrame:
    """Items with a window in the document, named in string order."""
    pairs = (
        equal.select(F.struct("doc_id", "text_hash").alias("doc_key"), "length", "window_text")
        .distinct()
        .join(items.select("length", "window_text", "item"), ["length", "window_text"])
        .groupBy("doc_key", "item")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = pairs.groupBy("doc_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return named.select(
        "doc_key", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that are not contaminated, all columns and repeated rows kept."""
    doc_id, text_hash = spare(docs, "dirty_id", "dirty_hash")
    dirty = (
        contamination(docs, benchmark, **settings)
        .filter("contaminated")
        .select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(text_hash))
        .distinct()
    )
    same = docs["doc_id"].eqNullSafe(F.col(doc_id)) & (F.xxhash64(docs["text"]) == F.col(text_hash))
    return docs.join(dirty, same, "left_anti")
