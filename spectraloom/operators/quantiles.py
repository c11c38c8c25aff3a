"""Exact quantiles whose memory does not grow with the data.

Small inputs use Spark's exact ``percentile``.  Above ``gather_bound`` values per key the
wanted order statistics are located by repeated histogram refinement: every pass counts
bins map-side, keeps only the bin holding the wanted rank, and stops when that bin is a
single value or small enough to sort.  No task ever holds all values of a key, and a value
repeated any number of times costs one bin.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectrum import finite

GATHER_BOUND = 20_000
MAX_KEYS = 200_000
BINS = 256


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    gather_bound: int = GATHER_BOUND,
) -> dict[tuple, list[float]]:
    """Linear-interpolation quantiles of ``value`` for every key (keys are axis-sized, not data-sized).

    Returns ``{key tuple: [quantile per prob]}``; values that are not finite are ignored.
    """
    keys, probs = list(keys), list(probs)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        finite(F.col("_v"))
    )
    sizes = (
        rows.groupBy(*keys)
        .agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        .limit(MAX_KEYS + 1)
        .collect()
    )
    if len(sizes) > MAX_KEYS:
        raise ValueError("exact_quantiles expects axis-sized keys; group per-row data natively.")
    sizes = [r for r in sizes if r["n"]]
    if not sizes:
        return {}
    if max(r["n"] for r in sizes) <= gather_bound:
        wanted = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("q")
        return {
            tuple(r[k] for k in keys): list(r["q"])
            for r in rows.groupBy(*keys).agg(wanted).collect()
        }
    return _refine(rows, keys, probs, sizes, gather_bound)


def _refine(rows, keys, probs, sizes, gather_bound):
    spark = rows.sparkSession
    ranks = {}
    for r in sizes:
        key = tuple(r[k] for k in keys)
        for p in probs:
            position = (r["n"] - 1) * p
            for rank in {math.floor(position), math.ceil(position)}:
                ranks[(key, rank)] = (r["lo"], r["hi"], 0, r["n"])
    found: dict[tuple, float] = {}
    key_schema = "".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def brackets(pending):
        data = sorted({(*key, lo, hi) for (key, _), (lo, hi, _, _) in pending.items()})
        return F.broadcast(spark.createDataFrame(data, f"{key_schema}_lo double, _hi double"))

    def matched(pending):
        # one row per open bracket: axis-sized, so the broadcast side is bounded by MAX_KEYS
        inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
        if keys:
            return rows.join(brackets(pending), keys).filter(inside)
        # no key: a handful of brackets (two per probability), attached without a join
        open_brackets = sorted({(lo, hi) for lo, hi, _, _ in pending.values()})
        pairs = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in open_brackets])
        return rows.select("_v", F.explode(pairs).alias("_s")).select(
            "_v", F.col("_s.lo").alias("_lo"), F.col("_s.hi").alias("_hi")
        ).filter(inside)

    pending = dict(ranks)
    while pending:
        for item in [i for i, (lo, hi, _, _) in pending.items() if lo == hi]:
            found[item] = pending.pop(item)[0]
        small = {i: b for i, b in pending.items() if b[3] <= gather_bound}
        if small:
            wanted: dict[tuple, list[int]] = {}
            for (key, rank), (lo, hi, below, _) in small.items():
                wanted.setdefault((*key, lo, hi), []).append((rank, rank - below))
            gathered = (
                matched(small)
                .groupBy(*keys, "_lo", "_hi")
                .agg(F.sort_array(F.collect_list("_v")).alias("values"))
            )
            offsets = spark.createDataFrame(
                [(*b, rank, at) for b, pairs in wanted.items() for rank, at in pairs],
                f"{key_schema}_lo double, _hi double, _rank bigint, _at bigint",
            )
            picked = gathered.join(F.broadcast(offsets), [*keys, "_lo", "_hi"]).select(
                *keys, "_rank", F.get("values", F.col("_at").cast("int")).alias("x")
            )
            for r in picked.collect():
                found[(tuple(r[k] for k in keys), r["_rank"])] = r["x"]
            for item in small:
                pending.pop(item)
        if not pending:
            break
        # halves where the width itself would overflow; the ends fall in different bins, so brackets shrink
        share = F.when(
            finite(F.col("_hi") - F.col("_lo")), (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        ).otherwise((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2))
        bin_of = F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int"))
        counted = (
            matched(pending)
            .groupBy(*keys, "_lo", "_hi", bin_of.alias("_bin"))
            .agg(F.count("_v").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("b"))
            .collect()
        )
        by_bracket: dict[tuple, list] = {}
        for r in counted:
            by_bracket.setdefault((*[r[k] for k in keys], r["_lo"], r["_hi"]), []).append(r)
        for (key, rank), (lo, hi, below, _) in list(pending.items()):
            for r in sorted(by_bracket[(*key, lo, hi)], key=lambda r: r["_bin"]):
                if rank < below + r["c"]:
                    if (r["a"], r["b"]) == (lo, hi):
                        raise ArithmeticError(f"the bracket from {lo} to {hi} does not shrink")
                    pending[(key, rank)] = (r["a"], r["b"], below, r["c"])
                    break
                below += r["c"]
    out = {}
    for r in sizes:
        key = tuple(r[k] for k in keys)
        answer = []
        for p in probs:
            position = (r["n"] - 1) * p
            low, high = found[(key, math.floor(position))], found[(key, math.ceil(position))]
            below, above = math.floor(position), math.ceil(position)
            # as the built-in percentile weighs its two neighbours
            answer.append(low if low == high else (above - position) * low + (position - below) * high)
        out[key] = answer
    return out
