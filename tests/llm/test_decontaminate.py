from __future__ import annotations

import hashlib
import re

import pytest
from llm_fixtures import DATA, by_doc, docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=13):
    doc, hit, names = words(text), set(), []
    for name, item in items:
        w = words(item)
        n = min(len(w), window)
        wins = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        found = [s for s in range(len(doc) - n + 1) if tuple(doc[s : s + n]) in wins]
        hit |= {p for s in found for p in range(s, s + n)}
        names += ["" if name is None else str(name)] if found else []
    sha = hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
    return len(doc), len(hit), len(set(names)), sha, bool(hit) and 20 * len(hit) >= len(doc)


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
ITEMS = [
    (10, ITEM), (9, "one two three"), (2, "solo"), (3, ""), (4, None), (None, "five short words are here"),
    (11, "a a a a a a a a a a a a a a a a"), (12, ITEM), (13, "éa ßb çc ñd"),
]


def docs():
    cut = ITEM.split()
    return [
        (1, ITEM.upper() + "! tail"), (2, " ".join(cut[:13])), (3, " ".join(cut[:12]) + " x"), (4, "x " * 400 + ITEM),
        (5, "One, two: THREE. " * 3), (6, None), (7, ""), (8, "a " * 3_000), (9, "solo solo"), (9, "solo solo"),
        (None, "five short words are here " + " ".join(cut[2:15])), (11, " ".join(cut[1:14] + cut[3:16])), (12, "Éa ßb çc ñd"),
    ]


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.mark.parametrize("broadcast_rows", [D.BROADCAST_ROWS, 0])
def test_matches_brute_force(spark, docs_of, items_of, broadcast_rows):
    got = rows_of(D.contamination(docs_of(docs(), "1 AS gram"), items_of(ITEMS), broadcast_rows=broadcast_rows))
    assert len(got) == len(docs())
    texts = dict(docs())
    for r in got:
        want = brute(texts[r["doc_id"]], ITEMS)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want, r


def test_given_tables(spark, docs_of, sample_texts):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    for r in rows_of(D.contamination(docs_of(sample_texts), bench, broadcast_rows=0)):
        want = brute(dict(sample_texts)[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want


def test_empty_tables(spark, docs_of, items_of):
    assert D.contamination(docs_of([]), items_of(ITEMS)).count() == 0
    got = rows_of(D.contamination(docs_of(["some words", None]), items_of([])))
    assert [r["n_hit"] for r in got] == [0, 0] and not any(r["contaminated"] for r in got)
    assert len(rows_of(D.contamination(docs_of(["some words"]), items_of([(1, None), (2, " ")])))) == 1


def test_stage_keeps_clean_rows_and_columns(spark, docs_of, items_of):
    df = docs_of(docs(), "'k' AS dirty_hash")
    kept = D.keep_clean(df, items_of(ITEMS))
    dirty = {i for i, t in docs() if brute(t, ITEMS)[4]}
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]) for r in rows_of(kept))) == sorted(str(i) for i, _ in docs() if i not in dirty)


@pytest.mark.parametrize("rows", [D.BROADCAST_ROWS, 0])
def test_long_contaminated_text(spark, docs_of, rows):
    """60,000 words, all of them from 1,500 items of 40 words."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(1_500)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    text = " ".join(t for _, t in items)
    docs = docs_of([text, "none of it " * 20_000])
    got = by_doc(D.contamination(docs, benchmark, broadcast_rows=rows))
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["n_items"]) == (60_000, 60_000, 1_500) and got[0]["contaminated"]
    assert (got[1]["n_hit"], got[1]["n_items"]) == (0, 0)
