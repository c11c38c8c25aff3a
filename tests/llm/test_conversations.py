from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from llm_fixtures import DATA, rows_of

from spectraloom.llm import conversations as C

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute(codes):
    """Least (cost, audit) over the grammar's four states, from the last turn on."""

    def inserted(best):
        best = dict(best)
        for _, q, c in itertools.product(range(3), range(4), "ua"):
            t = NEXT.get((q, c))
            if t in best:
                best[q] = min(best.get(q, (10**9, "")), (best[t][0] + 5, "I" + best[t][1]))
        return best

    best = inserted({0: (0, ""), 3: (0, "")})
    for code in reversed(codes):
        found = {}
        for q in range(4):
            options = [(best[q][0] + 2, "D" + best[q][1])] if q in best else []
            for c in "" if code == "D" else "sua":
                t, same = NEXT.get((q, c)), c == code.lower()
                if t in best and (same or c != "s"):
                    cost = best[t][0] + (0 if same else 1) + (5 if code.isupper() else 0)
                    options.append((cost, ("K" if same else "R") + best[t][1]))
            if options:
                found[q] = min(options)
        best = inserted(found)
    return best[0]


def brute_report(rows):
    """The whole result of one conversation of (turn, role, text) rows, in plain Python."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    codes, found, seen = [], {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            found[fault] += 1
        code = role[:1] if role[:1] and role[:1] in "sua" else "x"
        codes.append("D" if fault in ("blank", "duplicate") else code.upper() if fault else code)
    cost, audit = brute(codes)
    left, kept = list(rows), []
    for edit in audit:
        row = left.pop(0) if edit != "I" else (None, None, "")
        if edit != "D":
            kept.append((edit, row[1], row[2]))
    led = bool(kept) and kept[0][0] == "K" and kept[0][1][:1] == "s"
    lines = [f"{role if edit == 'K' else 'user' if (k - led) % 2 == 0 else 'assistant'}:{text}" for k, (edit, role, text) in enumerate(kept)]
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **found,
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def reports(df):
    return {r.pop("conv_id"): r for r in rows_of(df)}


@pytest.mark.parametrize("alphabet,longest", [("suaxSUAXD", 4), ("ua", 9), ("uaD", 6), ("suaU", 5), ("sD", 6)])
def test_all_short_strings(alphabet, longest):
    for length in range(longest + 1):
        for codes in itertools.product(alphabet, repeat=length):
            assert C.align("".join(codes)) == brute(codes), codes


@pytest.mark.parametrize("narrow", [64, -1])
def test_long_strings(monkeypatch, narrow):
    """Cell by cell and as arrays, over the blocks that a trace fills in again."""
    monkeypatch.setattr(C, "NARROW", narrow)
    rng = random.Random(3)
    for weights in ((1, 20, 20, 1, 1, 2, 2, 1, 2), (1,) * 9, (5, 5, 1, 1, 1, 1, 1, 1, 5)):
        for n in (30, 90, 300):
            codes = "".join(rng.choices("suaxSUAXD", weights, k=n))
            assert C.align(codes) == brute(codes)
            assert C.align(codes)[0] <= C.incumbent(codes)


def test_whole_table(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall()
    given = spark.read.parquet(f"{DATA}/conversations.parquet")
    by_conv = {c: [] for c, *_ in rows}
    for conv, turn, role, text in brute_damage(rows):
        by_conv[conv].append((turn, role, text))
    want = {c: brute_report(r) for c, r in by_conv.items()}
    assert reports(C.audits(C.damaged(given))) == want


def test_odd_rows(spark):
    """Nulls, ties, repeats, unknown roles, dropped conversations, extra columns."""
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "sage"], ["Hi.", "no end", "", None, "\x1f", " x! \n", "é?", "b\xa0"]
    rows = [(c % 61 - 1, rng.choice([None, *range(7)]), rng.choice(roles), rng.choice(texts)) for c in range(1_500)]
    rows = [(None if c == -1 else c, t, r, x) for c, t, r, x in rows]
    lone = next(i for i in range(10**6, 10**7) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(lone, 0, "user", "All of it is dropped."), (77_000, 1, "user", "word " * 300_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kind", "2 AS copy", "'x' AS audit").repartition(5)
    by_conv = {c: [] for c, *_ in rows}
    for conv, turn, role, text in brute_damage(rows):
        by_conv[conv].append((turn, role, text))
    got = reports(C.audits(C.damaged(df)))
    assert got == {c: brute_report(r) for c, r in by_conv.items()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[lone] == {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": empty}
    # undamaged rows too
    assert reports(C.audits(C.cleaned(df)))[77_000]["cost"] == 2


def test_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"Turn {i % 2_500}.") for i in range(3_000)]
    assert reports(C.audits(spark.createDataFrame(rows, SCHEMA)))[1] == brute_report([r[1:] for r in rows])


def test_empty(spark):
    assert C.audits(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
