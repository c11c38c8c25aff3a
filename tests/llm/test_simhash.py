from __future__ import annotations

import numpy as np
import xxhash
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import simhash
from spectraloom.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints: dict[int, int], bits=4):
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprint_matches_brute_force(sample_texts):
    texts = [t for _, t in sample_texts[:60]] + [None, "", " \n\t", "one", "One two", "a b c d", "é " * 5_000]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) == brute_fingerprint(t)


def test_query_matches_brute_force(spark, docs_of, sample_texts):
    rows = [*sample_texts, (900, None), (901, ""), (902, "word"), (903, "word"), (903, "word")]
    got = rows_of(simhash.near_duplicates(docs_of(rows, "1 AS fp")))
    prints = {i: brute_fingerprint(t) for i, t in rows}
    want = brute_classes(prints)
    assert len(got) == len(rows)
    for r in got:
        assert r["fp"] & (2**64 - 1) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]


def planted(n=1500, seed=3):
    """Distinct fingerprints: a dense cluster within a few bits, chains of four-bit steps, noise."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(2**63))
    cluster = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (n, 2))}
    chain, at = set(), int(rng.integers(2**63))
    for _ in range(40):
        chain.add(at)
        for b in rng.choice(64, 4, replace=False):
            at ^= 1 << int(b)
    noise = {int(x) for x in rng.integers(0, 2**63, n)}
    return sorted(cluster | chain | noise)


def test_search_is_exact_in_all_layouts(spark):
    prints = planted()
    x = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    want = np.arange(len(x))
    while True:
        new = np.where(near, want[None, :], len(x)).min(axis=1)
        if (new == want).all():
            break
        want = new
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint").repartition(3)
    for blocks, group_rows in ((5, 1024), (5, 64), (6, 256), (7, 1024)):
        got = {r["node"]: r["root"] for r in components(simhash.links(df, blocks=blocks, group_rows=group_rows)).collect()}
        signed = x.view(np.int64)
        classes = {}
        for i, w in enumerate(want):
            classes.setdefault(w, []).append(int(signed[i]))
        for members in classes.values():
            if len(members) == 1:
                assert members[0] not in got
            else:
                assert {got[m] for m in members} == {min(members)}


def test_links_do_not_grow_with_pairs(spark):
    prints = planted(800)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in prints], "fp bigint")
    assert simhash.links(df, group_rows=128).count() < 60 * len(prints)


def test_keep_one(spark, docs_of):
    text = "the quick brown fox jumps over the lazy dog again and again " * 30
    rows = [(4, text), (2, text), (2, text), (None, text), (7, "other words here"), (None, "alone at last"), (9, None), (8, "")]
    kept = simhash.keep_one(docs_of(rows, "'x' AS Kept_id"))
    assert sorted(((r["doc_id"], r["text"]) for r in rows_of(kept)), key=str) == sorted(
        [(2, text), (7, "other words here"), (None, "alone at last"), (8, "")], key=str
    )
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "Kept_id"]


def test_empty(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0 and simhash.keep_one(docs_of([])).count() == 0


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1002, 1001), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[1002] == 1000 == got[1001]


