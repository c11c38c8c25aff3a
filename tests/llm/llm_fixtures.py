from __future__ import annotations

import duckdb
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
DATA = "/root/testdata/sf0.001"


@pytest.fixture
def docs_of(spark):
    """Documents from texts, or from (id, text) or (id, text, source) rows."""

    def make(rows, extra: str = ""):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = (*row, "s")[:3] if isinstance(row, tuple) else (i, row, "s")
            full.append((doc_id, text, "en", source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCS).repartition(3)
        return df.selectExpr("*", extra) if extra else df

    return make


@pytest.fixture(scope="session")
def sample_texts():
    """(doc_id, text) of the smallest given documents."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def rows_of(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def by_doc(df) -> dict:
    return {r["doc_id"]: r for r in rows_of(df)}


