"""The corpus pipeline: ``documents`` through quality rules, near-duplicate removal, benchmark
decontamination, mixing and encoding.

Each stage takes the documents its predecessor kept and returns the columns of ``documents``; the
last returns what the token files hold.  Between stages the rows are written as Parquet and read
again, so that a lost executor repeats a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm import decontaminate, mixing, near_copies, quality, token_store
from spectraloom.llm.text import table
from spectraloom.session import ship, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity 0.8 or more."""
    ship(spark)
    return near_copies.keep_one(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no 5 % of benchmark words."""
    ship(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights ask for."""
    ship(spark)
    return mixing.resampled(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places and checksums in the written token files."""
    ship(spark)
    return token_store.documents_of(token_store.write_store(docs))


STAGES = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_documents),
    ("mixing sources to target weights", mixed_documents),
    ("token-ID / binary output", token_files),
]

#: The tokenizers' measures and ids can't be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
