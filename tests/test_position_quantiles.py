"""Quantiles per position equal sorting, and no cell becomes a row."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import spectra_of

from spectraloom.operators import position_quantiles as Q
from spectraloom.operators import recipe
from spectraloom.spectra import Y

PROBS = [0.0, 0.25, 0.5, 0.77, 1.0]


def awkward(n=900):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 9))
    x[:, 1] = np.round(x[:, 1])  # ties, both zeros
    x[:, 2] = 7.5
    x[:, 3] = np.exp(40 * x[:, 3])
    x[:, 4] = np.where(rng.random(n) < 0.3, np.nan, x[:, 4])
    x[::5, 5] = np.inf
    x[1::5, 5] = -np.inf
    x[:, 6] = np.nan
    x[:, 7] = np.where(np.arange(n) % 2, 1.7e308, -1.7e308)
    x[:, 8] = np.where(np.arange(n) < n - 3, 5e-324 * np.arange(n), 1e300)
    return x


def expected(x, probs):
    out = np.full((x.shape[1], len(probs)), np.nan)
    for p in range(x.shape[1]):
        v = np.sort(x[np.isfinite(x[:, p]), p]) + 0.0
        for j, q in enumerate(probs):
            if len(v):
                at = (len(v) - 1) * q
                a, b = int(np.floor(at)), int(np.ceil(at))
                out[p, j] = v[a] if v[a] == v[b] else (b - at) * v[a] + (at - a) * v[b]
    return out


def test_keys_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf])
    keys = Q.ordered(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == 9
    assert np.array_equal(Q.doubles(keys), x + 0.0)


@pytest.mark.parametrize("gathered,counters", [(32, Q.COUNTERS), (0, Q.COUNTERS), (32, 5 * 256)])
def test_equal_to_sorting(spark, monkeypatch, gathered, counters):
    monkeypatch.setattr(Q, "GATHERED", gathered)
    monkeypatch.setattr(Q, "COUNTERS", counters)
    x = awkward()
    s = spectra_of(spark, x, np.arange(9.0), partitions=4)
    assert np.array_equal(Q.array_quantiles(s.df, 9, PROBS, Y), expected(x, PROBS), equal_nan=True)


def test_both_ways_of_a_recipe_agree(spark, monkeypatch):
    x = awkward(300)
    s = spectra_of(spark, x, np.arange(9.0))
    few = recipe.position_quantiles(s.df, 9, [0.25, 0.5, 0.75])
    monkeypatch.setattr(recipe, "GATHER_BOUND", 10)
    many = recipe.position_quantiles(s.df, 9, [0.25, 0.5, 0.75])
    assert np.array_equal(few, many, equal_nan=True)
    assert np.array_equal(recipe.median_fill(s), np.nan_to_num(many[:, 1]))


def test_nothing_is_exploded_and_counts_do_not_grow(spark, monkeypatch):
    """The plan of a pass has no Generate, and ten times the rows give as many shuffled counts."""
    plans, rows = [], []
    scanned = Q._scanned

    def watched(df, width, y, made, schema):
        out = scanned(df, width, y, made, schema)
        plans.append(out._jdf.queryExecution().toString())
        if schema.startswith("cell"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(Q, "_scanned", watched)
    rng = np.random.default_rng(0)
    for n in (2_000, 20_000):
        s = spectra_of(spark, rng.uniform(size=(n, 3)), np.arange(3.0), partitions=2)
        Q.array_quantiles(s.df, 3, [0.5], Y)
        rows.append(None)
    assert plans and not any("Generate" in p for p in plans)
    first = rows[0], rows[rows.index(None) + 1]
    assert max(first) <= 2 * 3 * 2 * Q.BINS and first[1] <= 1.5 * first[0]


def test_no_rows(spark):
    s = spectra_of(spark, np.zeros((3, 4)), np.arange(4.0))
    assert np.isnan(Q.array_quantiles(s.df.filter("false"), 4, [0.5], Y)).all()
