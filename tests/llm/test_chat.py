from __future__ import annotations

import hashlib

from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401

from spectraloom.llm import chat

COLUMNS = "tree string, node bigint, parent bigint, role string, text string, score double"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_paths_match_recursion(spark):
    import random

    rnd = random.Random(5)
    rows, parents = [], {}
    for tree in "ab":
        for i in range(60):
            node = i + (1000 if tree == "b" else 0)
            parent = None if i == 0 else node - rnd.randint(1, min(i, 4))
            parents[node] = parent
            rows.append((tree, node, parent, rnd.choice(["user", "assistant"]), f"m{node}", float(rnd.randint(0, 3))))
    inner = set(parents.values())
    score = {r[1]: r[5] for r in rows}
    want = {}
    for tree in "ab":
        leaves = [n for n in parents if n not in inner and (n >= 1000) == (tree == "b")]
        for leaf in sorted(leaves, key=lambda n: (-score[n], n))[:3]:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = parents[at]
            want[tree, leaf] = path
    got = {}
    for r in rows_of(chat.paths(spark.createDataFrame(rows, COLUMNS).repartition(4), top=3)):
        got.setdefault((r["tree"], r["leaf"]), {})[r["up"]] = r["node"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want


def test_format_is_reversible(spark):
    texts = ["<|im_end|>\n", "\\<|", "\\", "<|<|\\\\|>", "", None, "é😀\n<", "a\nb", "<\\|im_start|>"]
    rows = [("t", i, None if i == 0 else i - 1, r, t, 0.0) for i, (t, r) in enumerate(zip(texts, ["assistant", "user", "so <|im_end|>\nme", None, "assistant", "assistant", "assistant", "user", "assistant"]))]
    chats = chat.formatted(spark.createDataFrame(rows, COLUMNS))
    turns = chats.select(chat.turns_of(chats.chat).alias("t")).collect()[0].t
    assert [(t.role, t.text) for t in turns] == [(r[3] or "", r[4] or "") for r in rows]
    learned = chats.select(chat.learned_text(chats.chat, chats.mask).alias("t")).collect()[0].t
    assert learned == "".join(r[4] or "" for r in rows if r[3] == "assistant")
    (d,) = rows_of(chat.digests(chats))
    assert d["n_turns"] == len(rows) and d["loss_sha256"] == sha(learned) and d["loss_chars"] == len(learned)


def test_rings_and_repeats_are_left_out(spark):
    rows = [
        ("r", 1, 3, "user", "x", 0.0), ("r", 2, 1, "user", "x", 0.0), ("r", 3, 2, "user", "x", 0.0),
        ("r", 4, 3, "user", "below the ring", 0.0), ("r", 5, None, "user", "good", 0.0), ("r", 5, None, "user", "good", 0.0),
        ("r", 6, 77, "user", "orphan", 1.0), ("r", 8, 8, "user", "own parent", 0.0), (None, 9, None, None, None, None),
    ]
    got = {(r["tree"], r["leaf"]): r["node"] for r in rows_of(chat.paths(spark.createDataFrame(rows, COLUMNS), top=9))}
    assert got == {("r", 5): 5, ("r", 6): 6, (None, 9): 9}


def test_thread(spark):
    rows = [(7, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(200)]
    rows += [(8, 0, "user", "a"), (8, 0, "user", "a"), (8, 0, "assistant", "b"), (8, None, None, None), (None, 3, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS node", "2 AS tree")
    got = {r["tree"]: r for r in rows_of(chat.digests(chat.formatted(chat.thread(df))))}
    assert got[7]["n_turns"] == 200 and got[7]["turns_sha256"] == sha("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:200]))
    assert got[8]["turns_sha256"] == sha("\n\nassistant\nb\nuser\na\nuser\na\n") and got[8]["loss_chars"] == 1
    assert got[None]["n_turns"] == 1


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.formatted(chat.thread(empty))).count() == 0
