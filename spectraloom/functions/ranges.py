"""Wavenumber intervals: parsing, merging and turning them into retained axis positions."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np


def parse_ranges(text: str) -> list[tuple[float, float]]:
    """Read ``"500-1000; 2350-2450"`` into ordered ``(low, high)`` tuples."""
    found = []
    for token in filter(None, (part.strip() for part in re.split("[,;]", str(text)))):
        bounds = re.split("[-–]", token)
        if len(bounds) != 2:
            raise ValueError(f"Invalid range '{token}'. Use values like 500-1000.")
        low, high = sorted(float(b) for b in bounds)
        found.append((low, high))
    return found


def merge_ranges(ranges: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Union of closed intervals; touching intervals become one."""
    merged: list[tuple[float, float]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def normalize_exclusion(text: str) -> str:
    """Canonical text of an exclusion, e.g. ``"500-1000,2350-2450"``."""
    return ",".join(f"{low:g}-{high:g}" for low, high in merge_ranges(parse_ranges(text)))


def inside(axis: np.ndarray, ranges: list[tuple[float, float]]) -> np.ndarray:
    """Boolean mask of axis points covered by any closed interval."""
    axis = np.asarray(axis, dtype=float)
    mask = np.zeros(len(axis), dtype=bool)
    for low, high in ranges:
        mask |= (axis >= low) & (axis <= high)
    return mask


def runs(positions: np.ndarray) -> list[tuple[int, int]]:
    """Contiguous runs ``(start, length)`` of sorted 0-based positions."""
    positions = np.asarray(positions, dtype=int)
    if not len(positions):
        return []
    starts = np.flatnonzero(np.diff(positions, prepend=positions[0] - 2) != 1)
    ends = np.append(starts[1:], len(positions))
    return [(int(positions[a]), int(b - a)) for a, b in zip(starts, ends)]


@dataclass(frozen=True)
class ExclusionInfo:
    normalized: str
    ranges: tuple[tuple[float, float], ...]
    removed: int
    retained: int
    original: int

    def describe(self) -> str:
        if not self.normalized:
            return f"No hard spectral exclusion; all {self.original} variables are used."
        return (
            f"Hard spectral exclusion {self.normalized}: {self.removed} of {self.original} "
            f"variables removed before any analysis, {self.retained} retained."
        )
