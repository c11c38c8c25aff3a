from __future__ import annotations

import zlib

import corpus_pipeline
import duckdb
import numpy as np
from llm_fixtures import DATA, docs_of, rows_of, sample_texts  # noqa: F401
from test_decontaminate import brute as brute_contamination
from test_near_copies import brute_classes
from test_quality import brute as brute_base
from test_token_store import plain

from spectraloom.llm import mixing, quality, tokens


def test_stages_match_brute_force(spark):
    """The whole pipeline over the smallest tables, stage by stage in plain Python."""
    docs = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    path = quality.vocabulary_path()
    encode, fallback = tokens.rank_encoder(path), tokens.fallback_ids(path)

    def good(text, lang):
        base = brute_base(text)
        fit = quality.fertility(text, encode, fallback)[1:]
        return base[0] >= 50 and 100 * base[4] <= 50 * base[0] and quality.inside(quality.LANGUAGES[lang], *fit)

    left = {i: (t, s) for i, t, lang, s in docs if good(t, lang)}
    classes = brute_classes({i: t for i, (t, _) in left.items()})
    left = {i: x for i, x in left.items() if classes[i] == i}
    left = {i: x for i, x in left.items() if not brute_contamination(x[0], items)[4]}

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        columns = frame.columns
        frame = stage(spark, frame, DATA)
        assert frame.columns == columns
    assert sorted(r["doc_id"] for r in rows_of(frame)) == sorted(left)

    copies = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mixed(frame))}
    want, at = [], 0
    for i in sorted(left):
        ids = np.array([*plain().encode(left[i][0], add_special_tokens=False).ids, 2], dtype="<u4")
        for _ in range(copies[i]):
            want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows_of(corpus_pipeline.run(spark, DATA)))
    assert got == want and len(got) > len(left)


def test_stages_take_any_rows(spark, docs_of):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 9_000), (3, None)]
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs_of(rows, "1 AS salt"), docs_of([])):
            out = stage(spark, df, DATA)
            out.count()
            assert name == corpus_pipeline.STAGES[-1][0] or out.columns == df.columns
