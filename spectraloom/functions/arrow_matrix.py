"""Arrow list column <-> dense numpy block, used inside vectorised tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Turn a ``list<double>`` column into an ``n x width`` float64 matrix (null -> NaN)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        raise ValueError("A sample has no spectrum.")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return flat.reshape(0, width or 0)
    if len(flat) % n or (width is not None and len(flat) != n * width):
        raise ValueError("Wavenumber axis length does not match the spectral matrix.")
    return flat.reshape(n, len(flat) // n)


def to_list_array(matrix: np.ndarray) -> pa.Array:
    """Turn an ``n x p`` matrix into a ``list<double>`` Arrow array without row loops."""
    n, p = matrix.shape
    offsets = pa.array(np.arange(0, n * p + 1, p if p else 1, dtype=np.int32)[: n + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
