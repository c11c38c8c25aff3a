"""Spelling variants by reduced-alphabet generation.

The letters are hashed to a few symbols.  Every reduced word generates its full one-edit
neighbourhood over these symbols, which stays small (about ``2 * symbols * length`` strings, where the
letters themselves would give 180 times the length), and the neighbourhoods meet the reduced
vocabulary in a join.  Words one edit apart have reduced words at most one edit apart, so no pair is
missed; each candidate is then verified on the original strings.

Occurrences are counted in the tasks that read the texts, then summed up by word.  All further steps are
joins and grouped aggregates on words or reduced words, so no group outgrows the vocabulary's
own density, and a reduced word's bucket shrinks as the symbols grow with the vocabulary.  Only candidates that pass the verification are shuffled again.

A word's form is its most frequent near word, where that is ``dominance`` times as frequent or more;
following forms at least doubles the count at every step, so roots are found by pointer jumping in a
few rounds.

Edge cases: a null or empty text has no words; a null id stands as the empty string in the hash that
damages words; repeated rows count repeatedly; equal counts go by code point order; an empty table
gives no words; other columns are not read; a very long text is split once, in its own row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .text import byte_texts, pieces

#: Fixed values of the contract: the letters of a run, damaged runs, words that count.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
DAMAGED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
DOMINANCE = 2
#: A task's word counts go out when they hold so many words.
FLUSHED = 300_000
#: Characters that stand for symbols.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def damaged(run: str, doc_hash: int, every: int = DAMAGED) -> str:
    """The run, less one code point where its hash with the document says so."""
    h = zlib.crc32(run.encode(), doc_hash)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_length: int):
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes are lower-cased in A-Z only
                found = Counter(runs.findall((text or b"").lower().decode("utf-8", "replace")))
                for given, n in found.items():
                    word = damaged(given, prefix)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > FLUSHED:
                    yield flushed(counts)
                    counts = Counter()
        if counts:
            yield flushed(counts)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts, long and frequent enough to count."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted(least_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def symbols_for(words: int) -> int:
    """Symbols for a vocabulary: their number grows with the seventh root of its size, so that neither the strings
    of a neighbourhood nor the words that share a reduced form outgrow the words."""
    return min(max(3, round(0.72 * words ** (1 / 7))), 36)


def reduced(word: Column, symbols: int) -> Column:
    """The word with each letter replaced by its symbol."""
    return F.translate(word, LETTERS, "".join(ALPHABET[zlib.crc32(c.encode()) % symbols] for c in LETTERS))


def neighbourhood(word: Column, symbols: int) -> Column:
    """The word and all strings one deletion, replacement or insertion of a symbol away, each once."""
    length = F.length(word)

    def edited(first: int, skipped: int, symbol: str = "") -> Column:
        """The word at every place with ``skipped`` symbols less and ``symbol`` there."""
        return F.transform(
            F.sequence(F.lit(first), length),
            lambda i: F.concat(F.substring(word, F.lit(1), i - first), F.lit(symbol), F.substring(word, i - first + 1 + skipped, length)),
        )

    # a place runs from 1 for symbols, from 0 for the gaps around them; replacing a symbol by itself gives the word
    shorter = edited(1, 1)
    swapped = [edited(1, 1, s) for s in ALPHABET[:symbols]]
    longer = [edited(0, 0, s) for s in ALPHABET[:symbols]]
    return F.array_distinct(F.concat(shorter, *swapped, *longer))


def near_words(vocab: DataFrame, symbols: int) -> DataFrame:
    """``word, near, near_n``: every ordered pair of words exactly one edit apart."""
    keyed = written(vocab.withColumn("reduced", reduced(F.col("word"), symbols)))
    forms = keyed.select("reduced").distinct()
    met = forms.select(F.col("reduced").alias("home"), F.explode(neighbourhood(F.col("reduced"), symbols)).alias("reduced"))
    # neither side has a size bound, so neither may be broadcast
    there = met.join(keyed.hint("merge"), "reduced").select(F.col("home").alias("reduced"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = there.join(keyed.select("reduced", "word").hint("merge"), "reduced")
    return pairs.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of the chain of forms, by pointer jumping."""
    tree = written(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        onward = tree.filter("word != root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(tree.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        tree = jumped.select("word", "root")
        if not jumped.filter("moved").limit(1).count():
            return tree


def variants(
    docs: DataFrame,
    symbols: int | None = None,
    dominance: int = DOMINANCE,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    vocab = written(vocabulary(docs, least_length, least_count))
    symbols = symbols_for(vocab.count()) if symbols is None else symbols
    best = near_words(vocab, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    strong = -F.col("best.less") >= dominance * F.col("n")
    known = written(
        vocab.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(strong, F.col("best.near")).alias("form"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        )
    )
    return known.join(roots(known), "word").select("word", "form", "root", "n", "n_near", "form_n")
