"""Exact quantiles of every position of an array column, from histograms folded inside tasks.

No cell becomes a row.  Doubles are read as whole numbers in the same order, so a bracket of them is cut into
``BINS`` equal parts without rounding: a pass counts every open bracket's parts inside tasks, and only counts are
shuffled, ``positions x ranks x BINS`` of them a task whatever its rows.  The part that holds the wanted rank is the
next bracket, until it is one value or holds ``GATHERED`` values, which a last pass fetches.  Repeated values cost
one part, and eight passes part all doubles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_matrix import to_matrix

BINS = 256
GATHERED = 32
#: Counters that a task and the driver hold at once; more positions take turns.
COUNTERS = 1 << 23
SIGN = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys & SIGN, keys & ~SIGN, ~keys).view(np.float64)


def extents(df: DataFrame, width: int, y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Finite values of every position: how many, the least and the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = np.zeros(width, dtype=np.int64), np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(0), width)
                good = np.isfinite(x)
                n += good.sum(axis=0)
                low = np.minimum(low, np.where(good, x, np.inf).min(axis=0))
                high = np.maximum(high, np.where(good, x, -np.inf).max(axis=0))
        at = np.flatnonzero(n)
        columns = (at.astype(np.int32), n[at], low[at], high[at])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pos", "n", "lo", "hi"])

    parts = df.select(y).mapInArrow(run, "pos int, n bigint, lo double, hi double")
    found = parts.groupBy("pos").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    pos = found.column("pos").to_numpy()
    n, low, high = np.zeros(width, dtype=np.int64), np.zeros(width), np.zeros(width)
    n[pos], low[pos], high[pos] = (found.column(c).to_numpy() for c in ("n", "lo", "hi"))
    return n, low, high


def _scanned(df: DataFrame, width: int, y: str, made: Callable[[Iterator[np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``made`` gives for the matrices of a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (to_matrix(b.column(0), width) for b in batches if b.num_rows)
        for columns in made(whole):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return df.select(y).mapInArrow(run, schema)


class Brackets:
    """Open brackets, one per wanted (position, rank): keys ``low`` to ``high``, with ``below`` values under it and ``count`` in it."""

    def __init__(self, pos: np.ndarray, rank: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.pos, self.rank = pos, rank
        self.low, self.high = ordered(low[pos]), ordered(high[pos])
        self.below, self.count = np.zeros(len(pos), dtype=np.int64), n[pos]

    @property
    def step(self) -> np.ndarray:
        return (self.high - self.low) // np.uint64(BINS) + np.uint64(1)

    def narrow(self, df: DataFrame, width: int, y: str, at: np.ndarray) -> None:
        """One pass over the brackets ``at``."""
        pos, low, high, step = self.pos[at], self.low[at], self.high[at], self.step[at]

        def counted(matrices: Iterator[np.ndarray]) -> Iterator[tuple]:
            table = np.zeros(len(pos) * BINS, dtype=np.int64)
            for x in matrices:
                keys, good = ordered(x), np.isfinite(x)
                for slot in range(0, len(pos), SLOT):
                    part = slice(slot, slot + SLOT)
                    k = keys[:, pos[part]]
                    inside = good[:, pos[part]] & (k >= low[part]) & (k <= high[part])
                    row, column = np.nonzero(inside)
                    bins = (k[row, column] - low[part][column]) // step[part][column]
                    table += np.bincount((slot + column) * BINS + bins.astype(np.int64), minlength=len(table))
            used = np.flatnonzero(table)
            yield used.astype(np.int32), table[used]

        found = _scanned(df, width, y, counted, "cell int, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
        counts = np.zeros(len(pos) * BINS, dtype=np.int64)
        counts[found.column("cell").to_numpy()] = found.column("c").to_numpy()
        counts = counts.reshape(len(pos), BINS)
        upto = counts.cumsum(axis=1)
        chosen = (self.below[at][:, None] + upto <= self.rank[at][:, None]).sum(axis=1)
        row = np.arange(len(pos))
        self.count[at] = counts[row, chosen]
        self.below[at] += upto[row, chosen] - counts[row, chosen]
        self.low[at] = low + chosen.astype(np.uint64) * step
        self.high[at] = np.minimum(high, self.low[at] + step - np.uint64(1))

    def fetch(self, df: DataFrame, width: int, y: str, at: np.ndarray) -> np.ndarray:
        """The wanted values of brackets that hold few."""
        pos, low, high = self.pos[at], self.low[at], self.high[at]

        def kept(matrices: Iterator[np.ndarray]) -> Iterator[tuple]:
            for x in matrices:
                keys, good = ordered(x), np.isfinite(x)
                for slot in range(0, len(pos), SLOT):
                    part = slice(slot, slot + SLOT)
                    k = keys[:, pos[part]]
                    row, column = np.nonzero(good[:, pos[part]] & (k >= low[part]) & (k <= high[part]))
                    yield (slot + column).astype(np.int32), x[row, pos[part][column]]

        found = _scanned(df, width, y, kept, "slot int, v double").toArrow()
        slot, values = found.column("slot").to_numpy(), found.column("v").to_numpy()
        order = np.lexsort((values, slot))
        first = np.searchsorted(slot[order], np.arange(len(pos)))
        return values[order][first + (self.rank[at] - self.below[at])] + 0.0


#: Brackets looked at together, which bounds a batch's scratch.
SLOT = 512


def array_quantiles(
    df: DataFrame, width: int, probs: Sequence[float], y: str, known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
) -> np.ndarray:
    """``width x len(probs)`` quantiles by linear interpolation, NaN where a position has no finite value.

    ``known`` are the ``extents``, if they are at hand.
    """
    n, low, high = extents(df, width, y) if known is None else known
    filled = np.flatnonzero(n)
    out = np.full((width, len(probs)), np.nan)
    if not len(filled):
        return out
    wanted = sorted({(int(p), r) for p in filled for q in probs for r in (math.floor((n[p] - 1) * q), math.ceil((n[p] - 1) * q))})
    pos, rank = (np.array(c, dtype=np.int64) for c in zip(*wanted))
    b = Brackets(pos, rank, n, low, high)
    turn = max(1, COUNTERS // BINS)
    while True:
        open_ = np.flatnonzero((b.low < b.high) & (b.count > GATHERED))
        if not len(open_):
            break
        for at in range(0, len(open_), turn):
            b.narrow(df, width, y, open_[at : at + turn])
    value = doubles(b.low)
    few = np.flatnonzero(b.low < b.high)
    for at in range(0, len(few), turn):
        value[few[at : at + turn]] = b.fetch(df, width, y, few[at : at + turn])
    found = dict(zip(wanted, value.tolist()))
    for p in filled.tolist():
        for j, q in enumerate(probs):
            place = (n[p] - 1) * q
            below, above = math.floor(place), math.ceil(place)
            left, right = found[p, below], found[p, above]
            # as the built-in percentile weighs its two neighbours
            out[p, j] = left if left == right else (above - place) * left + (place - below) * right
    return out
