from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401
from tokenizers import Tokenizer

from spectraloom.llm import token_store as T
from spectraloom.llm import tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=3_000))
def test_levels_round_trip_and_random_access(ids):
    array = np.array(ids, dtype=np.uint32)
    levels = T.encode_levels(array)
    assert T.decode_levels(levels, len(ids)).tolist() == ids
    for i in range(0, len(ids), max(1, len(ids) // 50)):
        assert T.token_at(levels, i) == ids[i]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "'s", "'", "12", "!", "(", "…", "\x1c", "\x85", " ", "日", "<|endoftext|>", "😀", "\r\n", "_"]), max_size=12))
def test_chunks_do_not_change_the_ids(parts):
    text = "".join(parts)
    encoder = tokens.library_encoder(T.vocabulary_path())
    assert encoder.ids(text).tolist() == plain().encode(text, add_special_tokens=False).ids


def plain():
    if not hasattr(plain, "made"):
        plain.made = Tokenizer.from_file(T.vocabulary_path())
    return plain.made


def test_store_matches_brute_force(spark, docs_of, sample_texts):
    rows = [*sample_texts, (900, None), (901, ""), (902, "word " * 30_000), (903, "same"), (903, "same"), (None, "no id")]
    store = T.write_store(docs_of(rows, "1 AS shard"), block_ids=5_000)
    assert store.count() > 5
    got = sorted(rows_of(T.documents_of(store)), key=lambda r: r["start"])
    at = 0
    for r, (doc_id, text) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))):
        ids = np.array([*plain().encode(text or "", add_special_tokens=False).ids, T.END], dtype="<u4")
        assert r == {"doc_id": doc_id, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)
    assert len(got) == len(rows)
    block = rows_of(store.orderBy("shard", "block").limit(1))[0]
    levels = [x.asDict() for x in block["levels"]]
    ids = T.decode_levels(levels, block["n_ids"])
    assert all(T.token_at(levels, i) == ids[i] for i in range(0, len(ids), 97))


def test_empty(spark, docs_of):
    assert T.documents_of(T.write_store(docs_of([]))).count() == 0
