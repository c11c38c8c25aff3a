from __future__ import annotations

import zlib

from llm_fixtures import docs_of, rows_of, sample_texts  # noqa: F401
from pyspark.sql import functions as F

from spectraloom.llm import sharding


def checked(spark, docs, rows, shards=16, **settings):
    """Every row once, with its own size and checksum, on gapless places; returns the shards' sizes."""
    got = rows_of(sharding.sharded(docs, shards, **settings))
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((repr(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} <= {"bytes"} and {r["grown_shard"] for r in got} <= {None}
    loads = [0] * shards
    for s in range(shards):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        loads[s] = sum(r["size"] for r in mine)
    assert sum(loads) == sum(w[1] for w in want)
    return loads


def spread(loads, largest):
    return max(loads) - min(loads) <= largest


def test_given_table(spark, docs_of, sample_texts):
    largest = max(len(t.encode()) + 1 for _, t in sample_texts)
    assert spread(checked(spark, docs_of(sample_texts), sample_texts), largest)


def test_hot_rows(spark, docs_of):
    """A third of all rows is one repeated row, another third has no id."""
    rows = [(7, "same text again " * 3)] * 3_000 + [(None, "no id")] * 3_000 + [(i, f"text {i} " * (i % 40)) for i in range(3_000)]
    assert spread(checked(spark, docs_of(rows, "1 AS part"), rows), 2_000)


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (1, ""), (1, ""), (2, "é" * 50_000), (3, "x"), (None, None), (None, "y")]
    loads = checked(spark, docs_of(rows, "'v' AS vslot"), rows, 3, slots=8)
    assert max(loads) == 100_001  # a record larger than its share stays alone
    assert checked(spark, docs_of([]), []) == [0] * 16
    assert checked(spark, docs_of([(1, "a")]), [(1, "a")], 1) == [2]


def maps(spark, docs, shards=4, slots=64, heavy=8):
    rows = sharding.records(docs, slots).persist()
    weight = sharding.weights(rows).persist()
    return weight, sharding.versions(spark, weight, shards, slots, heavy)


def as_dict(slot_map, version):
    return {(r["vslot"], r["part"]): r["shard"] for r in rows_of(slot_map.filter(F.col("version") == version))}


def test_rebalancing_edits_the_map(spark, docs_of):
    rows = [(i, "w " * (1 + i * 7919 % 97)) for i in range(800)]
    weight, stored = maps(spark, docs_of(rows))
    first, second = as_dict(stored, 1), as_dict(stored, 2)
    assert first == {(s, -1): s * 4 // 64 for s in range(64)}
    assert {s for s, _ in second} == set(range(64))
    bytes_of = {}
    for r in rows_of(weight):
        bytes_of[r["vslot"]] = bytes_of.get(r["vslot"], 0) + r["bytes"]
    loads = [0] * 4
    for s, b in bytes_of.items():
        loads[first[s, -1]] += b
    moved = [s for s, part in second if part == -1 and second[s, part] != first[s, -1]]
    level = sum(loads) / 4
    # only slots of shards above the level move, about as many bytes as are above it
    assert moved and {first[s, -1] for s in moved} <= {i for i in range(4) if loads[i] > level}
    over = sum(max(0, b - level) for b in loads)
    assert over <= sum(bytes_of[s] for s in moved) <= over + 4 * max(bytes_of.values())
    again = sharding.rebalanced(stored, weight, 4, 8)
    settled = as_dict(again, 3)
    assert sum(settled[k] != second[k] for k in second) <= 4


def test_growth_moves_into_the_new_shard_only(spark, docs_of):
    rows = [(i, "w " * (1 + i * 31 % 53)) for i in range(900)]
    weight, stored = maps(spark, docs_of(rows))
    before, after = as_dict(stored, 2), as_dict(sharding.grown(stored, weight, 4, 8), 3)
    assert before.keys() == after.keys()
    assert all(after[k] in (before[k], 4) for k in before)
    unit = {(r["vslot"], r["part"]): r["bytes"] for r in rows_of(sharding.units(stored.filter("version = 2"), weight, 4, 8))}
    loads = [sum(b for k, b in unit.items() if after[k] == s) for s in range(5)]
    assert max(loads) - min(loads) <= 4 * max(unit.values())


def test_native_plan(spark, docs_of):
    plan = sharding.sharded(docs_of([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan
