from __future__ import annotations

import itertools
import math

import duckdb
import numpy as np
import pytest
import xxhash
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import near_copies


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar_pairs(texts: dict, least: float) -> dict:
    """Exact similarities of at least ``least``, of all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    shared, index = {}, {}
    for b, found in sets.items():
        for s in found:
            for a in index.get(s, ()):
                shared[a, b] = shared.get((a, b), 0) + 1
            index.setdefault(s, []).append(b)
    pairs = {(a, b): n / (len(sets[a]) + len(sets[b]) - n) for (a, b), n in shared.items()}
    return {p: s for p, s in pairs.items() if s >= least}


def closed(ids, pairs) -> dict:
    """The smallest id that each can reach."""
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def plain_print(text) -> tuple[np.ndarray, int]:
    """The fingerprint's bits and the number of distinct shingles, hash by hash."""
    hashes = {xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles(text)}
    ones = np.zeros((near_copies.WORDS, 64), dtype=int)
    for h in hashes:
        for j in range(near_copies.WORDS):
            x = (h + j * near_copies.STEP) % 2**64
            x = (x ^ x >> 30) * near_copies.MIX_A % 2**64
            x = (x ^ x >> 27) * near_copies.MIX_B % 2**64
            x ^= x >> 31
            ones[j] += [x >> b & 1 for b in range(64)]
    return 2 * ones > len(hashes), len(hashes)


def brute_classes(texts: dict, least=near_copies.SIMILARITY - near_copies.SLACK) -> dict:
    """Classes by the estimates of all pairs, without fronts and index."""
    found = {i: plain_print(t) for i, t in texts.items()}
    pairs = []
    for a, b in itertools.combinations(sorted(texts), 2):
        (x, n), (y, m) = found[a], found[b]
        shared = math.cos(math.pi * (x != y).mean()) * math.sqrt(n * m)
        if (n == m and (x == y).all()) or (n + m > shared and shared / (n + m - shared) >= least):
            pairs.append((a, b))
    return closed(texts, pairs)


def edited(words, rng, share):
    out = list(words)
    for at in rng.choice(len(out), max(1, round(share * len(out))), replace=False):
        out[at] = f"edit{rng.integers(10**9)}"
    return out


def near_texts(seed=5, families=60):
    """Families of texts with few edits each, and texts that share a long passage only."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = {}
    for f in range(families):
        base = [f"w{x}" for x in rng.integers(0, 3_000, 300)]
        for share in (0, 0.005, 0.01, 0.015):
            rows[len(rows)] = " ".join(edited(base, rng, share) if share else base)
        rows[len(rows)] = " ".join(edited(base, rng, 0.2))
        rows[len(rows)] = " ".join([*passage, *(f"v{x}" for x in rng.integers(0, 3_000, 150))])
    return rows


@pytest.mark.parametrize("group_rows", [1_024, 16])
def test_finds_similar_and_leaves_others(spark, docs_of, group_rows):
    texts = near_texts()
    got = {r["doc_id"]: r["root"] for r in rows_of(near_copies.classes(docs_of(list(texts.items())), group_rows=group_rows))}
    sure = similar_pairs(texts, 0.8)
    assert len(sure) > 200
    assert np.mean([got[a] == got[b] for a, b in sure]) >= 0.99
    allowed = closed(texts, similar_pairs(texts, 0.7))
    first = {}
    for i, root in got.items():
        assert allowed[first.setdefault(root, i)] == allowed[i]


def test_recall_on_given_documents(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{path}'").fetchall())
    got = {r["doc_id"]: r["root"] for r in rows_of(near_copies.classes(spark.read.parquet(path)))}
    sure = similar_pairs(texts, 0.8)
    assert np.mean([got[a] == got[b] for a, b in sure]) >= 0.9
    allowed = closed(texts, similar_pairs(texts, 0.7))
    first = {}
    for i, root in got.items():
        assert allowed[first.setdefault(root, i)] == allowed[i]


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(40):
            x = rng.integers(0, 2**63, 600).astype(np.uint64)
            shared = round(600 * 2 * similarity / (1 + similarity))
            y = np.append(x[:shared], rng.integers(0, 2**63, 600 - shared).astype(np.uint64))
            a, b = near_copies.wide_print(x)[0], near_copies.wide_print(y)[0]
            bits = np.bitwise_count(a ^ b).sum()
            errors.append(near_copies.estimate(bits, np.array(600), np.array(600)) - shared / (1200 - shared))
        assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_odd_rows(spark, docs_of):
    long = "the quick brown fox jumps over the lazy dog " + " ".join(f"w{i}" for i in range(30_000))
    rows = [(4, long), (2, long), (2, long), (None, long), (7, "other words"), (8, "Other WORDS"), (None, "alone at last"), (9, None), (8, "")]
    kept = near_copies.keep_one(docs_of(rows, "'x' AS Node"))
    assert sorted(((r["doc_id"], r["text"]) for r in rows_of(kept)), key=str) == sorted(
        [(2, long), (7, "other words"), (None, "alone at last"), (8, "")], key=str
    )
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "Node"]
    assert near_copies.keep_one(docs_of([])).count() == 0


def test_lower_case_is_ascii_only(spark, docs_of):
    texts = ["Été one two three four five", "été one two three four five"]
    assert near_copies.keep_one(docs_of(texts)).count() == 2


def test_given_documents_match_brute_force(spark, docs_of, sample_texts):
    texts = dict(sample_texts) | {900: None, 901: "", 902: "word"}
    got = {r["doc_id"]: r["root"] for r in rows_of(near_copies.classes(docs_of(list(texts.items()))))}
    want, first = brute_classes(texts), {}
    for i in sorted(texts):
        assert first.setdefault(got[i], i) == want[i]
