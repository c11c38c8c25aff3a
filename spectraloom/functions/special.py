"""Distribution tails needed for limits and p-values (driver-side scalars only)."""

from __future__ import annotations

import math
from statistics import NormalDist


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return result


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d1 * x / (d1 * x + d2), d1 / 2.0, d2 / 2.0) if x > 0 else 0.0


def f_quantile(q: float, d1: float, d2: float) -> float:
    """Inverse F CDF by bisection on the monotone CDF."""
    low, high = 0.0, 1.0
    while f_cdf(high, d1, d2) < q and high < 1e300:
        high *= 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if f_cdf(middle, d1, d2) < q:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)


def normal_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def spearman_p_value(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation through Student's t with n-2 degrees."""
    if n < 3 or not math.isfinite(rho):
        return math.nan
    if abs(rho) >= 1.0:
        return 0.0
    dof = n - 2
    t2 = rho * rho * dof / (1.0 - rho * rho)
    return beta_cdf(dof / (dof + t2), dof / 2.0, 0.5)


def chi2_sf(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution (series / continued fraction)."""
    if x <= 0 or dof <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    log_front = a * math.log(z) - z - math.lgamma(a)
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    tiny = 1e-300
    b = z + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return math.exp(log_front) * h
