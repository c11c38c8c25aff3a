"""Word splitting shared by the text operators, as column expressions and as byte helpers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything below U+0080 except letters and digits separates alphanumeric words.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The ASCII white space that separates plain words.
BLANK = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter unchanged."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def alnum_words(text: Column) -> Column:
    """Lower-cased alphanumeric words of a text; a null text has none."""
    return _split(ascii_lower(text), NOT_ALNUM)


def blank_words(text: Column) -> Column:
    """Words between ASCII white space, unchanged; a null text has none."""
    return _split(text, BLANK)


def _split(text: Column, separators: str) -> Column:
    # only the first and the last piece can be empty: a text may begin or end with separators
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that none of the documents' own columns has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few long texts at once."""
    return itertools.chain.from_iterable(
        (batch.slice(at, rows) for at in range(0, batch.num_rows, rows)) for batch in batches
    )
