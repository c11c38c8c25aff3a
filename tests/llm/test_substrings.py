from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import substrings


def brute(rows, window):
    texts = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts):
        gone = {i + j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted():
    word = lambda i: f"w{i * 7919 % 1013}"
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(word(i * 100 + j) for j in range(80)) + f" {passage}\n tail{i}") for i in range(6)]
    rows += [(20, passage), (21, " ".join(f"p{i}" for i in range(34))), (22, " ".join(f"p{i}" for i in range(10, 45)) + " x")]
    rows += [(30, "same " * 300), (31, "a b " * 40), (32, None), (33, ""), (34, "é ß " * 18), (35, "é ß " * 17)]
    rows += [(40, " ".join(f"twice{i}" for i in range(50)))] * 2 + [(None, " ".join(f"q{i}" for i in range(40)))] * 2
    rows += [(50, " ".join(f"r{i}" for i in range(40)) + "\t\x0b " + " ".join(f"r{i}" for i in range(40)))]
    rows += [(51, "Case " + " ".join(f"s{i}" for i in range(34))), (52, "case " + " ".join(f"s{i}" for i in range(34)))]
    return rows


@pytest.mark.parametrize("settings", [{}, {"group_rows": 2}, {"group_rows": 0}, {"window": 9, "gram": 3}, {"window": 5, "gram": 5}])
def test_matches_brute_force(spark, docs_of, sample_texts, settings):
    rows = [*planted(), *sample_texts[:60]]
    got = rows_of(substrings.deduplicated(docs_of(rows, "1 AS start"), **settings))
    found = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str)
    assert found == brute(rows, settings.get("window", 35))


def test_empty(spark, docs_of):
    assert substrings.deduplicated(docs_of([])).count() == 0
    assert [r["n_removed"] for r in rows_of(substrings.deduplicated(docs_of(["few words", None])))] == [0, 0]
