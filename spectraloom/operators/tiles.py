"""All-pairs work as bounded tiles.

Exact Euclidean neighbour and silhouette measures need every pair of rows.  Rows are hashed
into blocks of bounded size, each unordered pair of blocks is one task-sized tile, and a tile
returns only reductions (sums, minima, nearest distances, spanning edges) - never its pairs.
No cross join, no group larger than two blocks, whatever the key distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_matrix import to_matrix

TILE_ROWS = 4_096
LEAST_ROWS = 256
SUB_ROWS = 512
#: Blocks of work that is one matrix product: rows at most, and bytes of a block.
PAIR_ROWS, PAIR_BYTES = 16_384, 1 << 23
#: Rows of a strip of pairs: some megabytes, which stay in a core's cache.
STRIP_ROWS = 64
#: Products of centred rows give squared distances to this share of the largest squared length.
PRODUCT_ERROR = 1e-12
#: Pairs below this share are taken again by explicit differences.
CLOSE = 1e-6
#: Rows and columns of a block of single-precision products, and of columns of which one minimum is kept.
SCREEN_ROWS, SCREEN_COLUMNS = 512, 512
#: Single precision serves while it blurs radii by this share, for all but one row in a hundred.
BLUR = 0.05


def block_count(n: int, slots: int, tile_rows: int = TILE_ROWS) -> int:
    """Enough blocks to bound a tile's memory, and enough tiles to occupy the task slots.

    Each row is copied once per block, so blocks stay as large as those two aims allow.
    """
    bounded = -(-n // tile_rows)
    busy = min(math.isqrt(8 * slots), n // LEAST_ROWS)
    return max(1, bounded, busy)


def pair_rows(df: DataFrame, vector: str) -> int:
    """Rows of a block whose vectors take ``PAIR_BYTES`` at most."""
    found = df.select(F.size(vector).alias("p")).first()
    return max(1, min(PAIR_ROWS, PAIR_BYTES // (8 * max(1, found["p"] if found else 1))))


def assign_blocks(df: DataFrame, id_col: str, n: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Hash block per row over the whole table."""
    blocks = block_count(n, df.sparkSession.sparkContext.defaultParallelism, tile_rows)
    return df.withColumn("block", F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")).withColumn(
        "blocks", F.lit(blocks)
    )


def assign_group_blocks(
    df: DataFrame, size_col: str, id_col: str = "sample_index", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Hash block per row inside its own group; hot groups get many blocks, small ones get one."""
    blocks = F.ceil(F.col(size_col) / tile_rows).cast("int")
    return df.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    )


def group_tiles(
    df: DataFrame, group: Sequence[str], tile: Callable[[pa.Table], pa.Table], schema: str
) -> DataFrame:
    """Run ``tile`` on every unordered block pair (per group); ``df`` has ``block`` and ``blocks``."""
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_partner")
    spread = (
        df.select("*", partner)
        .withColumn("bi", F.least("block", "_partner"))
        .withColumn("bj", F.greatest("block", "_partner"))
        .drop("_partner", "blocks")
    )
    return spread.groupBy(*group, "bi", "bj").applyInArrow(tile, schema)


class Tile:
    """One block pair: left / right matrices and helpers on row positions."""

    def __init__(self, table: pa.Table, vector: str):
        block = table.column("block").to_numpy()
        self.same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        self.left = np.flatnonzero(block == table.column("bi")[0].as_py())
        self.right = np.flatnonzero(block == table.column("bj")[0].as_py())
        self.x = to_matrix(table.column(vector))

    def directions(self):
        """Ordered (rows, others) views: one for a diagonal tile, two otherwise."""
        yield self.left, self.right
        if not self.same:
            yield self.right, self.left

    def distances(self, rows: np.ndarray, others: np.ndarray, span: tuple[int, int] | None = None):
        """Yield ``(row slice, distances)`` in strips so memory stays bounded."""
        x = self.x if span is None else self.x[:, span[0] : span[1]]
        for at in range(0, len(rows), SUB_ROWS):
            part = rows[at : at + SUB_ROWS]
            yield part, np.sqrt(squared(x[part], x[others]))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by explicit differences: exact zeros, no cancellation."""
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    diff = np.empty((min(len(a), STRIP_ROWS), len(b)))
    for at in range(0, len(a), STRIP_ROWS):
        part, into = a[at : at + STRIP_ROWS], out[at : at + STRIP_ROWS]
        room = diff[: len(part)]
        for k in range(a.shape[1]):
            np.subtract(part[:, k, None], columns[k], out=room)
            np.multiply(room, room, out=room)
            into += room
    return out


def pair_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for rows side by side, to the same last bit."""
    diff = a - b
    np.multiply(diff, diff, out=diff)
    return np.add.reduce(np.ascontiguousarray(diff.T), axis=0)


class Products:
    """Squared distances between rows of one matrix by matrix products, off by ``error`` at most."""

    def __init__(self, x: np.ndarray):
        self.x = x
        centred = x - x.mean(axis=0) if len(x) else x
        norm = (centred * centred).sum(axis=1)[:, None]
        ones = np.ones_like(norm)
        self.scale = float(norm.max(initial=0.0))
        self.error = PRODUCT_ERROR * self.scale * max(1.0, x.shape[1] / 64)
        self._rows = np.hstack([-2.0 * centred, norm, ones])
        self._others = np.hstack([centred, ones, norm])

    def squared(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        return self._rows[rows] @ self._others[others].T

    def strips(self, rows: np.ndarray, others: np.ndarray, step: int = STRIP_ROWS):
        """Yield ``(row slice, squared distances)`` over a few rows at a time."""
        other = np.ascontiguousarray(self._others[others].T)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, self._rows[part] @ other

    def exactly(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Explicit squared distances of pairs side by side, in bounded pieces."""
        step = max(1, PAIR_BYTES // (128 * max(1, self.x.shape[1])))  # what a core's cache holds
        parts = [pair_squared(self.x[rows[at : at + step]], self.x[others[at : at + step]]) for at in range(0, len(rows), step)]
        return np.concatenate(parts) if parts else np.array([])

    def distances(self, rows: np.ndarray, others: np.ndarray, step: int = STRIP_ROWS):
        """Yield ``(row slice, distances)``; close pairs are taken by explicit differences, so copies are at zero."""
        for part, d in self.strips(rows, others, step):
            flat = d.ravel()
            close = np.flatnonzero(flat <= CLOSE * self.scale)
            if len(close):
                i, j = np.divmod(close, len(others))
                flat[close] = self.exactly(part[i], others[j])
            yield part, np.sqrt(d, out=d)


class Screen:
    """Squared distances in single precision, too small or too large by up to ``blur`` of both rows' squared lengths.

    ``sign`` tells which: -1 never hides a pair within a radius, 1 never lets a bound come out too small.
    """

    def __init__(self, x: np.ndarray, sign: int):
        middle = np.median(x[:: max(1, len(x) // 2_048)], axis=0) if len(x) else 0.0
        centred = x - middle
        self.norm = (centred * centred).sum(axis=1)
        self.blur = 2.0 * (x.shape[1] + 8) * 2.0**-24
        norm = ((1.0 + sign * self.blur) * self.norm)[:, None]
        ones = np.ones_like(norm)
        # some lengths are too large for single precision, or too small
        self.fits = bool(np.isfinite(norm).all() and norm.max(initial=0.0) < 1e37)
        with np.errstate(over="ignore"):
            self._rows = np.hstack([-2.0 * centred, norm, ones]).astype(np.float32)
            self._others = np.hstack([centred, ones, norm]).astype(np.float32)

    def sharp(self, squares: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows whose squared radius is large against what single precision blurs."""
        return 2.0 * self.blur * self.norm[rows] <= BLUR * squares

    def least(self, rows: np.ndarray, others: np.ndarray, k: int, groups: int) -> np.ndarray:
        """Bounds of the k-th least squared distance to the others: the k-th least of minima over groups of them."""
        other = np.ascontiguousarray(self._others[others].T)
        whole = len(others) // groups * groups
        out, room = np.empty(len(rows)), np.empty((STRIP_ROWS, len(others)), dtype=np.float32)
        for at in range(0, len(rows), STRIP_ROWS):
            part = self._rows[rows[at : at + STRIP_ROWS]]
            d = np.matmul(part, other, out=room[: len(part)])
            low = d[:, :whole].reshape(len(d), -1, groups).min(axis=1)
            out[at : at + STRIP_ROWS] = np.partition(np.hstack([low, d[:, whole:]]), k - 1, axis=1)[:, k - 1]
        return out

    def pairs(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray, same: bool):
        """Yield ``(rows, others)``: all pairs whose squared distance may be within the limit of one of them.

        ``limit`` is -inf for rows that don't ask.  With ``same`` sides a pair comes once, a row with itself too.
        """
        left = left[np.argsort(limit[left], kind="stable")]
        right = left if same else right[np.argsort(limit[right], kind="stable")]
        # one room serves all blocks: new memory costs more than the products
        room, flags = np.empty(SCREEN_ROWS * SCREEN_COLUMNS, dtype=np.float32), np.empty(SCREEN_ROWS * SCREEN_COLUMNS, dtype=bool)
        for at in range(0, len(right), SCREEN_COLUMNS):
            others = right[at : at + SCREEN_COLUMNS]
            other = np.ascontiguousarray(self._others[others].T)
            # rows of equal limits lie together, so one number serves a block first
            for row_at in range(0, min(len(left), at + SCREEN_COLUMNS) if same else len(left), SCREEN_ROWS):
                rows = left[row_at : row_at + SCREEN_ROWS]
                top = max(limit[rows[-1]], limit[others[-1]])
                if top < 0:
                    continue
                shape = len(rows), len(others)
                d = np.matmul(self._rows[rows], other, out=room[: shape[0] * shape[1]].reshape(shape))
                i, j = _set(np.less_equal(d, np.float32(top * (1 + 1e-6)), out=flags[: d.size].reshape(shape)))
                if same:
                    once = row_at + i <= at + j
                    i, j = i[once], j[once]
                near = d[i, j] <= np.maximum(limit[rows[i]], limit[others[j]]) * (1 + 1e-6)
                if near.any():
                    yield rows[i[near]], others[j[near]]


def _set(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the few flags that are set, looked for eight at a time."""
    if flags.shape[1] % 8:
        return np.nonzero(flags)
    words = np.flatnonzero(flags.reshape(-1).view(np.uint64))
    word, byte = np.nonzero(flags.reshape(-1, 8)[words])
    return np.divmod(words[word] * 8 + byte, flags.shape[1])
