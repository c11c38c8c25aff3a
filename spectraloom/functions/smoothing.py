"""Savitzky-Golay and polynomial-baseline operators applied to a block of spectra.

Both are linear per row and depend only on the axis length, so they are applied as a few
vectorised passes over a block instead of a dense ``p x p`` product.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def effective_window(width: int, window: int, poly: int) -> int:
    """Odd window of at least ``poly + 2`` points that fits the axis."""
    wanted = max(int(window), poly + 2) | 1
    fitting = min(wanted, width if width % 2 else width - 1)
    if fitting <= poly:
        raise ValueError("Too few variables remain for Savitzky-Golay preprocessing.")
    return fitting


@lru_cache(maxsize=256)
def weights(window: int, poly: int, deriv: int, at: int) -> np.ndarray:
    """Weights giving the ``deriv``-th derivative of the local least-squares fit at offset ``at``."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1, dtype=float), poly + 1, increasing=True)
    basis = np.array(
        [
            math.perm(k, deriv) * float(at) ** (k - deriv) if k >= deriv else 0.0
            for k in range(poly + 1)
        ]
    )
    return basis @ np.linalg.pinv(design)


def savgol(block: np.ndarray, window: int, poly: int, deriv: int = 0) -> np.ndarray:
    """Filter every row; the ends use the polynomial fitted to the outermost window."""
    width = block.shape[1]
    window = effective_window(width, window, poly)
    half = window // 2
    out = np.empty_like(block)
    center = weights(window, poly, deriv, 0)
    inner = width - window + 1
    acc = np.zeros((block.shape[0], inner))
    for k in range(window):
        acc += center[k] * block[:, k : k + inner]
    out[:, half : half + inner] = acc
    if half:
        left = np.array([weights(window, poly, deriv, at) for at in range(-half, 0)])
        right = np.array([weights(window, poly, deriv, at) for at in range(1, half + 1)])
        out[:, :half] = block[:, :window] @ left.T
        out[:, width - half :] = block[:, width - window :] @ right.T
    return out


def remove_baseline(block: np.ndarray, order: int) -> np.ndarray:
    """Subtract each row's least-squares polynomial on the index grid [-1, 1]."""
    grid = np.linspace(-1.0, 1.0, block.shape[1])
    basis, _ = np.linalg.qr(np.vander(grid, int(order) + 1))
    return block - (block @ basis) @ basis.T


def suggest_window(width: int) -> int:
    """Default smoothing window: about 1.5% of the axis, odd, between 7 and 31 points."""
    odd_width = width if width % 2 else width - 1
    if width < 7:
        return max(3, odd_width)
    return min(min(31, max(7, round(width * 0.015))) | 1, odd_width)
