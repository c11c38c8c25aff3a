from __future__ import annotations

import random
import re
import time

from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import licenses
from spectraloom.llm.licenses import NOTICES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute_base(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    places, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        hit = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hit
        labels |= {label} if hit else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), words


def least_edits(phrase, words):
    """Fewest edits to a stretch of whole words, by dynamic programming over the text."""
    text = f" {' '.join(words).encode().decode('latin-1')} "
    row = [10**6]  # a match begins after a space; characters before the phrase's first are edits
    for j in range(1, len(text)):
        row.append(0 if text[j - 1] == " " else row[-1] + 1)
    for c in phrase:
        new = [row[0] + 1]
        for j in range(1, len(text)):
            new.append(min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min((row[j] for j in range(1, len(text)) if text[j] == " "), default=10**6)


def damaged(rnd, text, edits):
    for _ in range(edits):
        i = rnd.randrange(len(text))
        text = rnd.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_query_matches_brute_force(spark, docs_of, sample_texts):
    rows = [*sample_texts[:80], (900, None), (901, ""), (902, "MIT License mit-license, é apache\nLICENSE mit license license"), (903, "mit license"), (903, "mit license"), (904, "the mit license " * 4_000)]
    got = rows_of(licenses.scan(docs_of(rows, "1 AS labels")))
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[:5]
        assert set(filter(None, want[4].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert licenses.scan(docs_of([])).count() == 0


def test_fuzzy_search_finds_what_dynamic_programming_finds():
    rnd = random.Random(2)
    filler = "the quick brown license public mit general words of this text and apache software".split()
    for trial in range(150):
        notice = rnd.choice(NOTICES)
        middle = damaged(rnd, notice.words, rnd.randint(0, notice.edits + 2))
        text = " ".join([*rnd.choices(filler, k=rnd.randint(0, 8)), middle, *rnd.choices(filler, k=rnd.randint(0, 8))])
        words = WORD.findall(text)
        labels = set(licenses.scanned(text.encode())[5].split(",")) - {""}
        want = {n.label for n in NOTICES if least_edits(n.words, words) <= n.edits}
        assert labels == want, (text, labels ^ want)


def test_spans_and_score():
    *_, labels, score, spans = licenses.scanned("Some words: Gnu Lesser Generel Public License, v3".encode())
    assert labels == "gpl,lgpl" and 0.9 < score < 1
    assert {"label": "lgpl", "first_word": 2, "last_word": 6, "edits": 1} in spans


def test_very_long_text_of_pieces():
    """A notice's beginning again and again, and the whole notice once in the end."""
    text = "permission is hereby granted free of charge " * 20_000 + NOTICES[3].words.replace("person", "persons")
    began = time.monotonic()
    *_, labels, score, spans = licenses.scanned(text.encode())
    assert time.monotonic() - began < 20
    assert labels == "mit" and spans == [{"label": "mit", "first_word": 140_000, "last_word": 140_012, "edits": 1}]


def test_neighbouring_matches_stay_apart():
    text = "all rights reserved all right reserved all rights  reserved"
    spans = licenses.scanned(text.encode())[-1]
    assert [(x["first_word"], x["last_word"], x["edits"]) for x in spans] == [(0, 2, 0), (3, 5, 1), (6, 8, 0)]
