from __future__ import annotations

import re

import pytest
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import mixing


def brute_targets(sizes):
    """Targets by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = {s: weight[s] for s in names if s not in capped}
        target = {s: left * w / sum(free.values()) for s, w in free.items()}
        above = {s for s in target if target[s] > 2 * sizes[s]}
        if not above:
            return target | {s: 2.0 * sizes[s] for s in capped}
        capped |= above


def corpus(n=3_000):
    rows = []
    for i in range(n):
        source = [None, "b", "a", "", "é", "Z", "b", "b"][i * 37 % 8]
        rows.append((i, "w " * (1 + i * 7919 % 211), source))
    return rows + [(9_000, None, "a"), (9_001, "", "only empty"), (9_002, " \n", "b"), (9_003, "x y", "b"), (9_003, "x y", "b"), (None, "x", "b")]


def test_targets_and_copies(spark, docs_of):
    rows = corpus()
    got = rows_of(mixing.mixed(docs_of(rows, "1 AS salt")))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split() if text else [])
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert 0 <= r["copies"] <= 2 and (r["size"] or not r["copies"])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert not r["size"] or int(rate) <= r["copies"] <= -int(-rate // 1)
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for source, words in taken.items():
        assert abs(words - want[source]) <= 0.02 * want[source] + 250
    again = {(r["doc_id"], r["text_hash"], r["copies"]) for r in rows_of(mixing.mixed(docs_of(rows).repartition(7)))}
    assert again == {(r["doc_id"], r["text_hash"], r["copies"]) for r in got}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1_000, None: 5}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 997}])
def test_caps(spark, docs_of, sizes):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())]
    got = {r["source"]: r["target"] for r in rows_of(mixing.mixed(docs_of(rows)))}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-9 * (1 + want[s]) for s in sizes)


def test_resampled_rows(spark, docs_of):
    rows = corpus(300)
    df = docs_of(rows, "'c' AS mixed_hash")
    copies = {}
    for r in rows_of(mixing.mixed(df)):
        key = (r["doc_id"], r["source"])
        copies[key] = copies.get(key, 0) + r["copies"]
    out = mixing.resampled(df)
    seen = {}
    for r in rows_of(out):
        seen[r["doc_id"], r["source"]] = seen.get((r["doc_id"], r["source"]), 0) + 1
    assert out.columns == df.columns and seen == {k: n for k, n in copies.items() if n}


def test_empty(spark, docs_of):
    assert mixing.mixed(docs_of([])).count() == 0 and mixing.resampled(docs_of([])).count() == 0
    assert [r["copies"] for r in rows_of(mixing.mixed(docs_of([None, ""])))] == [0, 0]


def test_sizes(spark, docs_of, sample_texts):
    rows = [*sample_texts[:50], (900, " a\x0b\x0cb\r\n\tc "), (901, "\xa0a\x1fb")]
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in rows}
    assert {r["doc_id"]: r["size"] for r in rows_of(mixing.mixed(docs_of(rows)))} == want
