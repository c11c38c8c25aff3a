"""Quality rules: repetition, symbols, and how a public vocabulary's tokens fit the text.

A text is measured by its tokens in a public byte-level vocabulary (``vocabulary``, a path):
characters per token, the share of tokens that are parts of characters (byte fallback), and the
entropy of its tokens, divided by the logarithm of their number or of ``ENTROPY_TOKENS``, whichever is
less: entropy stops growing with the text, so the divisor must, too.  Prose of a language that the
vocabulary knows stays inside a band of each; symbol runs, machine strings and repetition
leave it.  Bands are given per language, and per script for texts of another or no language.

Whole texts are measured, one row at a time, in Arrow batches; nothing is shuffled.

Edge cases: a null text has no words and fails the base rules; so does an empty one.  Repeated
rows get equal results.  A null or unknown language takes its script's band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .text import pieces

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: From this many tokens on a text's entropy is compared with a fixed number of bits.
ENTROPY_TOKENS = 8_192


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte fallback, least relative entropy."""

    low: float
    high: float
    fallback: float
    entropy: float = 0.45


#: Real prose lies between 3.3 and 5.6 characters per token here, and above only if still easier to
#: tokenise: the upper bounds are for runs of long tokens, the lower ones for junk.
LANGUAGES = {
    "en": Band(2.0, 8.0, 0.05),
    "de": Band(2.05, 8.0, 0.10),
    "fr": Band(1.9, 8.0, 0.12),
    "es": Band(1.9, 8.0, 0.12),
}
SCRIPTS = {
    "latin": Band(1.5, 8.0, 0.20),
    "cyrillic or greek": Band(0.8, 5.0, 0.35),
    "cjk": Band(0.4, 3.0, 0.90),
    "other": Band(0.3, 5.0, 0.95),
}
#: First code points of the scripts' ranges, and the script from there on.
RANGES = ((0, "latin"), (0x370, "cyrillic or greek"), (0x530, "other"), (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"))


def script(text: str) -> str:
    """The script of most characters beyond ASCII punctuation and digits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = points[(points >= 0x80) | ((points | 0x20) - ord("a") < 26)]
    if not len(letters):
        return "latin"
    place = np.searchsorted([start for start, _ in RANGES], letters, side="right") - 1
    count = np.bincount(place, minlength=len(RANGES))
    names = [name for _, name in RANGES]
    return max(SCRIPTS, key=lambda s: sum(c for c, name in zip(count, names) if name == s))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    n = len(seen)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), dtype=bool)
    for j in range(3):
        covered[j : len(words) - 2 + j] |= again
    return int(covered.sum())


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines and repeated words of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def fertility(text: str | None, encode, fallback: np.ndarray) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share and relative token entropy."""
    ids = encode(text or "")
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = float(-(share * np.log2(share)).sum() / np.log2(min(max(2, len(ids)), ENTROPY_TOKENS)))
    return len(ids), len(text) / len(ids), float(fallback[ids].mean()), entropy


def inside(band: Band, chars_per_token: float, fallback: float, entropy: float) -> bool:
    return band.low <= chars_per_token <= band.high and fallback <= band.fallback and entropy >= band.entropy


SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double, "
    "kept boolean"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def measures(
    docs: DataFrame,
    vocabulary: str | None = None,
    languages: dict[str, Band] = LANGUAGES,
    scripts: dict[str, Band] = SCRIPTS,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns ``carry`` (``doc_id`` by default) and the measures of each row's whole text."""
    path = vocabulary or vocabulary_path()
    carry = ["doc_id"] if carry is None else carry

    def measured(text: str | None, lang: str | None, encode, fallback) -> tuple:
        base = base_measures(text)
        failed = base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]
        fit = fertility(text, encode, fallback)
        kept = not failed and inside(languages.get(lang) or scripts[script(text)], *fit[1:])
        return *base, failed, *fit, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fallback = tokens.rank_encoder(path), tokens.fallback_ids(path)
        for batch in pieces(batches):
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found = zip(*[measured(t, g, encode, fallback) for t, g in zip(texts, langs)])
            made = [pa.array(c, type=k) for c, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *made], names)

    fields = [f.split()[0] for f in SCHEMA.split(", ")]
    places = [f"c{i}" for i in range(len(carry))]
    names = [*places, *fields]
    kinds = [{"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]] for f in SCHEMA.split(", ")]
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("text").alias("t"), lang.alias("g"), *[F.col(f"`{c}`").alias(p) for c, p in zip(carry, places)]
    )
    carried = ", ".join(f"{p} {docs.schema[c].dataType.simpleString()}" for c, p in zip(carry, places))
    found = rows.mapInArrow(run, f"{carried}, {SCHEMA}" if carry else SCHEMA)
    return found.select(*[F.col(p).alias(c) for c, p in zip(carry, places)], *fields)


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """The rows that the rules keep, all columns unchanged."""
    found = measures(docs, carry=docs.columns, **settings)
    # a measure named like one of the documents' own columns stays behind
    n = len(docs.columns)
    inner = found.toDF(*[f"d{i}" for i in range(n)], *[f.split()[0] for f in SCHEMA.split(", ")])
    return inner.filter("kept").select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])
