"""Single-precision screens hide no pair and give no bound that is too small."""

from __future__ import annotations

import numpy as np
import pytest

from spectraloom.operators import neighbors
from spectraloom.operators.neighbors import _near_pairs, distance_bounds
from spectraloom.operators.tiles import Screen


def cloud(rng, kind, n, d):
    x = rng.normal(size=(n, d))
    if kind == "outliers":
        x[:: n // 9] *= 1e6
    if kind == "far":  # two clouds, far apart against their size
        x = x * 1e-3 + 1e5 * (np.arange(n) % 2)[:, None]
    if kind == "copies":
        x[n // 2 :] = x[: n - n // 2]
    return x


class Pairs:
    """What ``_near_pairs`` needs of a tile."""

    def __init__(self, x, same):
        half = np.arange(len(x)) < len(x) // 2
        self.x, self.same = x, same
        self.left = np.arange(len(x)) if same else np.flatnonzero(half)
        self.right = self.left if same else np.flatnonzero(~half)


@pytest.mark.parametrize("kind", ["plain", "outliers", "far", "copies"])
@pytest.mark.parametrize("d", [2, 64])
@pytest.mark.parametrize("same", [False, True])
def test_no_pair_is_hidden(kind, d, same):
    rng = np.random.default_rng(5)
    x = cloud(rng, kind, 620, d)
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    radius = np.sort(true, axis=1)[:, 6] * rng.uniform(0.9, 1.1, len(x))
    limit = np.where(np.arange(len(x)) % 5 == 0, -np.inf, radius**2 * (1 + 1e-9))
    t = Pairs(x, same)
    found = [np.concatenate(v) for v in zip(*_near_pairs(t, limit))]
    pairs = {(min(a, b), max(a, b)) for a, b in zip(*found[:2])}
    assert len(pairs) == len(found[0]) and np.allclose(found[2], true[found[0], found[1]])
    wanted = true**2 <= np.maximum(limit[:, None], limit[None])
    for a in t.left:
        assert all((min(a, b), max(a, b)) in pairs for b in t.right if wanted[a, b])


def test_rows_that_do_not_ask_cost_nothing():
    """Blocks in which no row asks are left out, as are pairs far apart."""
    x = np.random.default_rng(0).normal(size=(900, 8))
    limit = np.full(900, -np.inf)
    assert not list(Screen(x, -1).pairs(np.arange(450), np.arange(450, 900), limit, False))
    limit[7] = 1e-6
    (mine, other), = Screen(x, -1).pairs(np.arange(900), np.arange(900), limit, True)
    assert list(mine) == list(other) == [7]


@pytest.mark.parametrize("kind", ["plain", "outliers", "far", "copies"])
@pytest.mark.parametrize("d", [2, 64])
def test_bounds_hold_k_rows(spark, kind, d):
    x = cloud(np.random.default_rng(5), kind, 1_500, d)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    found = distance_bounds(rows.repartition(2), 3, len(x), 1_000).toPandas().sort_values("id")
    kth = np.sqrt(np.sort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, 2])
    assert (found.radius >= kth * (1 - 1e-12)).all()
    assert np.median(found.radius / np.maximum(kth, 1e-300)) < 10 if kind != "copies" else True


@pytest.mark.parametrize("kind", ["plain", "outliers", "far"])
def test_kth_distances_by_all_pairs(spark, kind):
    x = cloud(np.random.default_rng(9), kind, 700, 64)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "sample_index bigint, x array<double>")
    found = neighbors.kth_distance(rows, "x", 5, len(x), tile_rows=300).toPandas().sort_values("sample_index")
    assert np.allclose(found.kth_distance, np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), axis=1)[:, 4], rtol=1e-12)

