"""Row-wise spectrum functions as native Column expressions over ``array<double>``.

Everything here stays in the JVM.  ``_let`` binds a per-row scalar once so that a
higher-order function does not re-evaluate it for every array element.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ranges import runs


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def literal(vector) -> Column:
    """A driver-side vector (axis, weights, fitted means) as an array literal."""
    return F.lit(np.asarray(vector, dtype=float))


def total(y: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda acc, v: acc + v)


def mean(y: Column) -> Column:
    return total(y) / F.size(y)


def sum_squares_about(y: Column, center: Column) -> Column:
    return F.aggregate(y, F.lit(0.0), lambda acc, v: acc + (v - center) * (v - center))


def std_pop(y: Column) -> Column:
    return _let(mean(y), lambda m: F.sqrt(sum_squares_about(y, m) / F.size(y)))


def dot(y: Column, weights: Column) -> Column:
    return total(F.zip_with(y, weights, lambda a, b: a * b))


def _nonzero(value: Column) -> Column:
    return F.when(value == 0.0, F.lit(1.0)).otherwise(value)


def snv(y: Column) -> Column:
    """Standard normal variate: (y - mean) / population sd, flat spectra divided by 1."""
    stats = F.struct(mean(y).alias("m"))
    return _let(
        stats,
        lambda s: _let(
            _nonzero(F.sqrt(sum_squares_about(y, s["m"]) / F.size(y))),
            lambda sd: F.transform(y, lambda v: (v - s["m"]) / sd),
        ),
    )


def vector_normalize(y: Column) -> Column:
    """Unit Euclidean length; an all-zero spectrum is returned unchanged."""
    return _let(
        _nonzero(F.sqrt(sum_squares_about(y, F.lit(0.0)))),
        lambda norm: F.transform(y, lambda v: v / norm),
    )


def trapezoid_weights(axis) -> np.ndarray:
    """Weights w with ``sum(w * f(axis))`` equal to the trapezoid integral of f."""
    axis = np.asarray(axis, dtype=float)
    step = np.diff(axis)
    weights = np.zeros(len(axis))
    weights[:-1] += step / 2.0
    weights[1:] += step / 2.0
    return weights


def absolute_area(y: Column, axis) -> Column:
    return total(F.zip_with(y, literal(trapezoid_weights(axis)), lambda v, w: F.abs(v) * w))


def area_normalize(y: Column, axis) -> Column:
    """Divide by the trapezoid integral of |y| over the physical axis."""
    return _let(
        _nonzero(absolute_area(y, axis)), lambda area: F.transform(y, lambda v: v / area)
    )


def keep_positions(y: Column, positions) -> Column:
    """Column pruning inside an array: contiguous slices of the retained axis."""
    parts = [F.slice(y, start + 1, length) for start, length in runs(positions)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def finite(v: Column) -> Column:
    """Whether a cell holds a number: neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def fill_missing(y: Column, fill: Column) -> Column:
    """Replace elements that are not finite by the aligned element of ``fill``."""
    return F.zip_with(y, fill, lambda v, m: F.when(finite(v), v).otherwise(m))


def affine(y: Column, shift: Column, scale: Column | None = None) -> Column:
    """(y - shift) / scale element by element."""
    centered = F.zip_with(y, shift, lambda v, m: v - m)
    if scale is None:
        return centered
    return F.zip_with(centered, scale, lambda v, s: v / s)


def missing_count(y: Column) -> Column:
    return F.size(F.filter(y, lambda v: ~finite(v)))


def median(y: Column) -> Column:
    """Exact median of one spectrum (middle of the sorted array)."""
    return _let(
        F.array_sort(y),
        lambda s: (
            F.get(s, F.floor((F.size(s) - 1) / 2).cast("int"))
            + F.get(s, F.floor(F.size(s) / 2).cast("int"))
        )
        / 2.0,
    )
