"""Pairs by matrix products give what explicit differences give."""

import numpy as np
import pytest
from conftest import by_id, points_of

from spectraloom.operators import neighbors, tiles


def test_products_keep_copies_at_zero():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 7)) + 1e5
    x[50:90] = x[3]
    x[7] = x[8] + 1e-9
    want = np.sqrt(tiles.squared(x, x))
    got = np.concatenate([d for _, d in tiles.Products(x).distances(np.arange(300), np.arange(300))])
    assert np.allclose(got, want, rtol=1e-7, atol=0) and (got[50:90, 50:90] == 0).all() and got[7, 8] > 0
    i, j = np.divmod(np.arange(90_000), 300)
    assert np.array_equal(np.sqrt(tiles.Products(x).exactly(i, j)), want.ravel())


def test_rows_whose_guess_is_too_small_ask_again(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(500, 12))
    real, calls = neighbors.distance_bounds, []

    def short(rows, k, n, sample=neighbors.BOUND_SAMPLE):
        calls.append(k)
        return real(rows, k if len(calls) == 1 else 1, n, sample)

    monkeypatch.setattr(neighbors, "distance_bounds", short)
    monkeypatch.setattr(neighbors, "pays", lambda *a: False)
    got = by_id(neighbors.kth_distance(points_of(spark, x), "x", 30, 500, tile_rows=120)).kth_distance.to_numpy()
    assert len(calls) == 2 and np.array_equal(got, np.sort(np.sqrt(tiles.squared(x, x)), axis=1)[:, 29])


@pytest.mark.parametrize("many", [1, 48])
def test_sums_per_label_in_both_directions(monkeypatch, many):
    monkeypatch.setattr(neighbors._Labelled, "MANY", many)
    rng = np.random.default_rng(4)
    codes, d = rng.integers(-1, 5, 40), rng.random((30, 40))
    side = neighbors._Labelled(codes)
    want = np.stack([d[:, codes == c].sum(axis=1) for c in range(5)], axis=1)
    into = np.zeros((30, 5), order="F")
    for at in (0, 25):
        side.add_rows(into, d[:, at : at + 25].T, at)
    assert np.allclose(side.totals(d), want) and np.allclose(into, want)


def test_no_more_than_k_copies_of_a_point_take_part(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 2)), rng.integers(1, 9, 60), axis=0)
    x = np.concatenate([x, np.tile([[0.5, 0.5]], (200, 1))])
    real, seen = neighbors._kth_of_rows, []
    monkeypatch.setattr(neighbors, "_kth_of_rows", lambda rows, k, n, *rest: seen.append(n) or real(rows, k, n, *rest))
    got = by_id(neighbors.kth_distance(points_of(spark, x), "x", 5, len(x), tile_rows=50)).kth_distance.to_numpy()
    assert np.array_equal(got, np.sort(np.sqrt(tiles.squared(x, x)), axis=1)[:, 4])
    assert seen == [np.minimum(np.unique(x, axis=0, return_counts=True)[1], 5).sum()]
