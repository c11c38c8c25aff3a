from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401
from pyspark.sql import functions as F

from spectraloom.llm import spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        others = sorted((-m, x) for x, m in words.items() if abs(len(x) - len(w)) <= 1 and x != w and near(x, w))
        form = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = {"form": form, "n": n, "n_near": len(others), "form_n": words[form] if form else None}
    for w in out:
        end = w
        while out[end]["form"]:
            end = out[end]["form"]
        out[w]["root"] = end
    return out


def got(df):
    return {r.pop("word"): r for r in rows_of(df)}


@pytest.mark.parametrize("symbols", [None, 3, 12])
def test_whole_table(spark, docs_of, sample_texts, symbols):
    """Any alphabet gives the pairs that all pairs give."""
    texts = sample_texts[:60]
    want = brute(texts)
    assert got(spelling.variants(docs_of(texts), symbols)) == want
    assert sum(r["form"] is not None for r in want.values()) > 20


def test_chains_ties_and_accents(spark, docs_of):
    rng = random.Random(2)
    words = {"colour": 40, "color": 80, "colors": 20, "colorsx": 9, "colorsxy": 4, "éclair": 6, "eclair": 6, "eclairs": 3, "abcde": 8, "abcdf": 16, "abcdg": 16, "naïve": 12, "naive": 3, "aaaaa": 30, "aaaaaa": 3, "œuvre": 9, "four": 50, "fours": 10, "ÀÉÎõü": 4}
    pool = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(pool)
    rows = [(i, " ".join(w.upper() if w.isascii() and rng.random() < 0.3 else w for w in pool[i::7])) for i in range(7)]
    rows += [(None, "hello hello! hello_hello"), (8, None), (9, ""), (9, "twice twice"), (9, "twice twice"), (10, "x" * 200_000 + " " + "word0" * 50_000)]
    result = got(spelling.variants(docs_of(rows, "'z' AS word"), 3))
    assert result == brute(rows)
    assert result["colorsxy"]["root"] == "color" and result["colorsxy"]["form"] == "colorsx"
    assert result["abcde"]["form"] == "abcdf" and result["eclair"]["form"] is None


def test_neighbourhoods(spark):
    words = ["", "0", "012", "0011"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", spelling.neighbourhood(F.col("w"), 3).alias("all"))
    for r in df.collect():
        w, want = r["w"], {r["w"]}
        want |= {w[:i] + w[i + 1 :] for i in range(len(w))}
        want |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in "012"} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in "012"}
        assert sorted(r["all"]) == sorted(want) and len(r["all"]) == len(set(r["all"]))


def test_no_unchecked_broadcast(spark, docs_of):
    vocab = spark.createDataFrame([("apple", 3), ("apples", 9)], "word string, n bigint")
    plan = spelling.near_words(vocab, 4)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "CartesianProduct" not in plan


def test_empty(spark, docs_of):
    assert spelling.variants(docs_of([])).count() == 0 and spelling.variants(docs_of([None, "", "one two"])).count() == 0
    assert spelling.symbols_for(0) == 3 and spelling.symbols_for(10**9) > spelling.symbols_for(10**6)
