"""Second-moment (Gram) accumulation: the one wide pass behind PCA, its CV and PLS.

Every task folds its own rows into per-key Gram matrices (BLAS over Arrow batches) and
emits them in fixed-size pieces; the pieces are summed by Spark's vector Summarizer with
map-side combine.  The driver only ever receives ``keys x p^2`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.arrow_matrix import to_list_array, to_matrix
from ..spectra import Y
from .recipe import Chain

PIECE = 16_384
MAX_WIDTH = 8_192
#: Bytes of Gram matrices that a task and the driver hold at once; more take further scans.
GRAM_BYTES = 1 << 30
#: Up to so many keys are taken for granted before they are counted.
FREE_KEYS = 64


@dataclass
class Moments:
    """Count, sum and uncentered Gram matrix of rows shifted by ``pivot``."""

    n: float
    total: np.ndarray
    gram: np.ndarray
    pivot: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.gram + other.gram, self.pivot)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.gram - other.gram, self.pivot)

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def scatter(self, about: np.ndarray | None = None) -> np.ndarray:
        """Sum of outer products of rows about ``about`` (own mean by default)."""
        m = self.mean if about is None else about
        cross = np.outer(self.total, m)
        return self.gram - cross - cross.T + self.n * np.outer(m, m)


def accumulate(
    df: DataFrame,
    chains: Sequence[Chain],
    pivots: Sequence[np.ndarray],
    key: str | None = None,
    y: str = Y,
    side: str | None = None,
    side_width: int = 0,
    budget: int = GRAM_BYTES,
) -> dict[tuple[int, int], Moments]:
    """Moments of every chain's output per integer ``key``, in a single scan while they fit ``budget``.

    ``key`` may also be an ``array<int>`` column: the row then counts under each of its keys
    (subsamples, for example) without being copied; null entries are skipped.  ``side`` names an optional second array column (class indicators) appended to each row,
    so that cross moments come from the same pass.  Returns ``{(chain, key): Moments}``.
    """
    widths = [len(c.axis) + side_width for c in chains]
    if max(widths) > MAX_WIDTH:
        raise ValueError(
            f"{max(widths)} variables exceed the {MAX_WIDTH}-variable Gram bound; narrow the axis first."
        )
    many = key is not None and isinstance(df.schema[key].dataType, ArrayType)
    code = F.col(key).cast("array<int>" if many else "int") if key else F.lit(0)
    columns = [F.col(y).alias("_y"), code.alias("_k")]
    if side:
        columns.append(F.col(side).alias("_side"))

    rows = df.select(*columns)
    capacity = max(1, budget // (8 * (max(widths) + 1) ** 2))
    everything = range(len(chains))
    if key is None or capacity >= len(chains) * FREE_KEYS:
        shares = [(everything, None)] if key or capacity >= len(chains) else [
            (everything[at : at + capacity], None) for at in range(0, len(chains), capacity)
        ]
    else:
        named = rows.select(F.explode("_k") if many else F.col("_k")).distinct().collect()
        keys = sorted(r[0] for r in named if r[0] is not None)
        per_scan = min(len(keys), capacity) or 1
        at_once = max(1, capacity // per_scan)
        shares = [
            (everything[c : c + at_once], frozenset(keys[k : k + per_scan]))
            for c in range(0, len(chains), at_once)
            for k in range(0, len(keys), per_scan)
        ]
    out: dict[tuple[int, int], Moments] = {}
    for chosen, wanted in shares:
        out |= _scan(rows, chains, pivots, widths, many, side_width, chosen, wanted)
    return out


def _scan(
    rows: DataFrame,
    chains: Sequence[Chain],
    pivots: Sequence[np.ndarray],
    widths: Sequence[int],
    many: bool,
    side_width: int,
    chosen: range,
    wanted: frozenset[int] | None,
) -> dict[tuple[int, int], Moments]:
    """The moments of some chains and keys (all if None)."""
    side = len(rows.columns) > 2

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = to_matrix(batch.column(0))
            keys = to_matrix(batch.column(1)) if many else batch.column(1).to_numpy(zero_copy_only=False)[:, None]
            extra = to_matrix(batch.column(2), side_width) if side else None
            for c in chosen:
                z = chains[c].apply(raw) - pivots[c]
                if extra is not None:
                    z = np.hstack([z, extra])
                z = np.hstack([z, np.ones((len(z), 1))])
                for codes in keys.T:
                    for k in np.unique(codes[np.isfinite(codes)]):
                        if wanted is not None and k not in wanted:
                            continue
                        part = z[codes == k]
                        piece = part.T @ part
                        at = (c, int(k))
                        if at in sums:
                            sums[at] += piece
                        else:
                            sums[at] = piece
        for (c, k), gram in sums.items():
            packed = gram[np.triu_indices(len(gram))]
            for at in range(0, len(packed), PIECE):
                values = packed[at : at + PIECE]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c], pa.int32()),
                        pa.array([k], pa.int32()),
                        pa.array([at // PIECE], pa.int32()),
                        to_list_array(values[None, :]),
                    ],
                    names=["c", "k", "piece", "v"],
                )

    pieces = rows.mapInArrow(fold, "c int, k int, piece int, v array<double>")
    summed = (
        pieces.select("c", "k", "piece", array_to_vector("v").alias("v"))
        .groupBy("c", "k", "piece")
        .agg(Summarizer.sum(F.col("v")).alias("v"))
        .select("c", "k", "piece", vector_to_array("v").alias("v"))
        .toArrow()
    )
    packed: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for batch in summed.to_batches():
        c, k, piece = (batch.column(i).to_pylist() for i in range(3))
        for i in range(batch.num_rows):
            packed.setdefault((c[i], k[i]), {})[piece[i]] = batch.column(3)[i].values.to_numpy()
    out = {}
    for (c, k), parts in packed.items():
        size = widths[c] + 1
        full = np.zeros((size, size))
        full[np.triu_indices(size)] = np.concatenate([parts[i] for i in sorted(parts)])
        full = np.triu(full) + np.triu(full, 1).T
        out[(c, k)] = Moments(full[-1, -1], full[-1, :-1].copy(), full[:-1, :-1].copy(), np.asarray(pivots[c]))
    return out
