import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraloom.functions import ranges, smoothing, special


def test_ranges_parse_merge_and_format():
    assert ranges.parse_ranges("800-500; 700–1000,, ") == [(500, 800), (700, 1000)]
    assert ranges.normalize_exclusion("500-800,700-1000, 2350-2450") == "500-1000,2350-2450"
    assert ranges.normalize_exclusion("1-2,2-3") == "1-3"
    for bad in ("abc", "1-2-3", "500"):
        with pytest.raises(ValueError):
            ranges.parse_ranges(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 100), st.floats(0, 30)), max_size=6))
def test_merging_never_changes_coverage(pairs):
    spans = [(a, a + w) for a, w in pairs]
    axis = np.linspace(0, 130, 400)
    merged = ranges.merge_ranges(spans)
    assert (ranges.inside(axis, spans) == ranges.inside(axis, merged)).all()
    assert all(b[0] > a[1] for a, b in zip(merged, merged[1:]))


def test_runs_cover_positions():
    assert ranges.runs([0, 1, 2, 5, 7, 8]) == [(0, 3), (5, 1), (7, 2)]
    assert ranges.runs([]) == []


def test_distribution_tails():
    assert special.f_quantile(0.95, 3, 97) == pytest.approx(2.698397539523104, rel=1e-9)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert special.chi2_sf(40.0, 10) == pytest.approx(1.694474e-05, rel=1e-4)
    # t = 2.228138852 is the two-sided 5% point for 10 degrees of freedom
    rho = 2.2281388519649385 / math.sqrt(10 + 2.2281388519649385**2)
    assert special.spearman_p_value(rho, 12) == pytest.approx(0.05, rel=1e-8)


@pytest.mark.parametrize("window,poly,deriv", [(11, 2, 0), (11, 2, 1), (7, 3, 2), (21, 3, 1)])
def test_savgol_equals_local_polynomial_fits(window, poly, deriv):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 40))
    got = smoothing.savgol(x, window, poly, deriv)
    half = window // 2
    for row, out in zip(x, got):
        for i in range(40):
            start = min(max(i - half, 0), 40 - window)
            grid = np.arange(window) - half
            fit = np.polynomial.Polynomial.fit(grid, row[start : start + window], poly).convert()
            at = i - (start + half)
            assert out[i] == pytest.approx(fit.deriv(deriv)(at) if deriv else fit(at), abs=1e-9)


def test_savgol_reproduces_polynomials_and_window_rules():
    t = np.linspace(-1, 1, 31)
    quad = np.vstack([1 + t + t**2, 2 - t])
    assert np.allclose(smoothing.savgol(quad, 11, 2), quad)
    assert smoothing.effective_window(100, 4, 2) == 5
    assert smoothing.effective_window(6, 11, 2) == 5
    with pytest.raises(ValueError):
        smoothing.effective_window(3, 11, 4)
    assert [smoothing.suggest_window(p) for p in (5, 6, 80, 1000, 4000)] == [5, 5, 7, 15, 31]


def test_baseline_removes_its_own_order():
    t = np.linspace(-1, 1, 50)
    rows = np.vstack([3 + 2 * t - t**2, t**2])
    assert np.abs(smoothing.remove_baseline(rows, 2)).max() < 1e-12
