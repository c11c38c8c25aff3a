import threading

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import by_id, points_of, spectra_of
from spectraloom import session
from spectraloom.operators import clustering, kmeans, label_sums, metrics, neighbors, qc
from spectraloom.operators.ward import ward


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.5, (50, 2)) for c in ((0, 0), (5, 0), (0, 5), (2, 2))])
    x[190:] = x[0]  # copies of one point
    return x, points_of(spark, x), np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def brute_silhouette(d, labels):
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][same].sum() / (same.sum() - 1)
        b = min(d[i][labels == o].mean() for o in set(labels) if o != own)
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.array(out)


def brute_dbscan(d, eps, min_samples):
    near = d <= eps
    core = near.sum(1) >= min_samples
    label, found = -np.ones(len(d), dtype=int), 0
    for i in range(len(d)):
        if label[i] >= 0 or not core[i]:
            continue
        stack, label[i] = [i], found
        while stack:
            for u in np.flatnonzero(near[stack.pop()]):
                if label[u] < 0:
                    label[u] = found
                    if core[u]:
                        stack.append(u)
        found += 1
    return label


def brute_ward(x):
    x, s, alive, heights = x.copy(), np.ones(len(x)), np.ones(len(x), dtype=bool), []
    while alive.sum() > 1:
        idx = np.flatnonzero(alive)
        d2 = ((x[idx][:, None] - x[idx][None]) ** 2).sum(-1)
        h = np.sqrt(2 * s[idx][:, None] * s[idx][None] / (s[idx][:, None] + s[idx][None]) * d2)
        np.fill_diagonal(h, np.inf)
        i, j = (idx[k] for k in np.unravel_index(h.argmin(), h.shape))
        heights.append(h.min())
        x[i] = (s[i] * x[i] + s[j] * x[j]) / (s[i] + s[j])
        s[i] += s[j]
        alive[j] = False
    return np.array(heights)


@pytest.mark.parametrize("tile", [60, 2048])
def test_kth_distance(blobs, tile):
    x, df, d = blobs
    got = by_id(neighbors.kth_distance(df, "x", 5, 200, tile_rows=tile)).kth_distance
    assert np.array_equal(got.to_numpy(), np.sort(d, axis=1)[:, 4])


@pytest.mark.parametrize("tile", [60, 2048])
def test_silhouettes_of_many_labelings(spark, blobs, tile):
    x, df, d = blobs
    one = np.arange(200) // 50
    two = np.where(np.arange(200) == 7, "lonely", np.where(x[:, 0] > 1, "r", "l"))
    labels = spark.createDataFrame(
        [(i, int(a), str(b), int(a) if i % 3 else None) for i, (a, b) in enumerate(zip(one, two))],
        "sample_index bigint, a int, b string, c int",
    )
    joined = df.join(labels, "sample_index")
    got = neighbors.silhouette_parts(joined, ["a", "b", "c"], "x", 200, tile_rows=tile).toPandas()
    assert np.allclose(by_id(got_part(got, 0)).silhouette, brute_silhouette(d, one))
    assert np.allclose(by_id(got_part(got, 1)).silhouette, brute_silhouette(d, two))
    keep = np.arange(200) % 3 > 0
    assert np.allclose(by_id(got_part(got, 2)).silhouette, brute_silhouette(d[np.ix_(keep, keep)], one[keep]))


class got_part:
    """Adapter so ``by_id`` can sort an already collected slice."""

    def __init__(self, frame, labeling):
        self.frame = frame[frame.labeling == labeling]

    def toPandas(self):
        return self.frame


@pytest.mark.parametrize("tile", [60, 2048])
@pytest.mark.parametrize("eps", [0.25, 0.45, 50.0, 1e-9])
def test_dbscan_equals_sequential_algorithm(blobs, tile, eps):
    x, df, d = blobs
    got = by_id(neighbors.dbscan(df, "x", eps, 5, 200, tile_rows=tile)).cluster.to_numpy()
    assert np.array_equal(got, brute_dbscan(d, eps, 5))


@pytest.mark.parametrize("tail,tile", [(256, 2048), (40, 70)])
def test_ward_heights_and_cuts(blobs, tail, tile):
    x, df, d = blobs
    tree = ward(df, "x", 200, tail=tail, tile_rows=tile)
    link = tree.linkage().orderBy("step").toPandas()
    assert np.allclose(link.height, brute_ward(x)) and len(link) == 199
    assert (link.left < link.right).all() and (link.right < 200 + link.step).all()
    assert sorted([*link.left, *link.right]) == list(range(398))
    cut = tree.labels([2, 4, 8]).toPandas()
    parts = np.array(cut.sort_values("sample_index").labels.tolist())
    assert [len(set(parts[:, i])) for i in range(3)] == [2, 4, 8]
    for a, b in ((1, 0), (2, 1)):  # finer cuts nest in coarser ones
        assert len({(p, q) for p, q in zip(parts[:, a], parts[:, b])}) == len(set(parts[:, a]))


def test_kmeans_and_history(blobs):
    x, df, d = blobs
    rows = df.select(F.lit(0).alias("g"), F.col("sample_index").alias("id"), "x")
    best = kmeans.fit(rows, [2, 4], 8)
    assert best[(0, 4)].inertia < best[(0, 2)].inertia
    labels, score = clustering.cluster(df, "x", "KMeans", 200, k=4)
    got = by_id(labels).cluster.to_numpy()
    near = ((x[:, None] - np.array([x[got == c].mean(0) for c in range(4)])[None]) ** 2).sum(-1)
    assert (near.argmin(1) == got).mean() > 0.99
    assert score == pytest.approx(brute_silhouette(d, got).mean())
    frames = kmeans.history(df, "x", 3)
    assert len(frames) >= 2 and not np.allclose(frames[0]["centers"], frames[-1]["centers"])


def test_benchmark_recovers_separated_groups(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (12, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    found = clustering.analyze(points_of(spark, x), "x", 36, restarts=5)
    assert found.best_params["k"] == 3 and found.agreement == pytest.approx(1.0)
    assert {"KMeans", "Agglomerative"} <= set(found.table.method)
    sizes = by_id(found.labels).cluster.value_counts()
    assert sorted(sizes) == [12, 12, 12] and "Recommended clustering" in found.report
    stable = clustering.cluster_stability(points_of(spark, x).withColumnRenamed("x", "s"), "s", 2, found, 36, 4)
    assert stable.score > 0.95 and stable.classification == "high"
    with pytest.raises(ValueError):
        clustering.analyze(points_of(spark, x[:3]), "x", 3)
    with pytest.raises(RuntimeError, match="UMAP"):
        clustering.embedding(None, "UMAP")


def test_methods_run_side_by_side(spark, monkeypatch):
    """Loops of short jobs don't wait for each other: each of the three only goes on once all have begun."""
    met = threading.Barrier(3)

    def meeting(kept):
        def run(*args, **given):
            met.wait(60)
            return kept(*args, **given)

        return run

    monkeypatch.setattr(clustering.kmeans, "fit", meeting(kmeans.fit))
    monkeypatch.setattr(clustering, "ward", meeting(clustering.ward))
    monkeypatch.setattr(clustering.neighbors, "kth_distance", meeting(neighbors.kth_distance))
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, (8, 2)) for c in ((0, 0), (6, 0), (0, 6))])
    assert clustering.analyze(points_of(spark, x), "x", 24, max_k=3, restarts=3).best_params["k"] == 3


def test_side_by_side_keeps_order_and_errors(spark):
    tasks = [lambda n=n: spark.range(n).count() for n in (5, 1, 3, 2, 4)]
    assert session.side_by_side(spark, tasks) == [5, 1, 3, 2, 4]
    with pytest.raises(ZeroDivisionError):
        session.side_by_side(spark, [lambda: 1, lambda: 1 // 0])


def test_adjusted_rand_values(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    assert metrics.ari_value(df, "a", "a") == 1.0
    assert metrics.ari_value(df, "a", "b") == pytest.approx(0.5714285714285714)


@pytest.mark.parametrize("tile", [None, 6])
def test_replicate_correlation_with_a_hot_group(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr("spectraloom.operators.tiles.assign_group_blocks.__defaults__", ("sample_index", tile))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 8)) + np.sin(np.arange(8)) * 3
    g = np.where(np.arange(30) < 22, "hot", np.where(np.arange(30) < 28, "small", [f"one{i}" for i in range(30)]))
    s = spectra_of(spark, x, np.arange(8.0), pd.DataFrame({"g": g}))
    got = qc.replicate_consistency(s, F.col("g")).toPandas().set_index("replicate_group")
    assert set(got.index) == {"hot", "small"}
    for name in got.index:
        r = np.corrcoef(x[g == name])[np.triu_indices((g == name).sum(), 1)]
        assert got.mean_pairwise_correlation[name] == pytest.approx(r.mean())
        assert got.minimum_pairwise_correlation[name] == pytest.approx(r.min())


def test_kmeans_seeds_on_all_rows(spark):
    """A handful of far rows must seed a centre of their own, however many rows there are."""
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal((0, 0), 1, (14_997, 2)), rng.normal((20, 0), 1, (14_997, 2)), rng.normal((10, 200), 1, (6, 2))])
    rows = [(0, i, [float(a), float(b)]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, id bigint, x array<double>").repartition(6)
    best = kmeans.fit(df, [3], 10)[(0, 3)]
    want = sum(((part - part.mean(axis=0)) ** 2).sum() for part in (x[:14_997], x[14_997:29_994], x[29_994:]))
    assert abs(best.inertia - want) < 1e-6 * want


def test_kmeans_with_fewer_points_than_centres(spark):
    df = spark.createDataFrame([(0, i, [float(i % 2), 1.0]) for i in range(20)], "g int, id bigint, x array<double>")
    assert kmeans.fit(df, [3], 3)[(0, 3)].inertia == 0.0


def test_distance_ranks_with_an_outlier(spark):
    from spectraloom.operators.stability import distance_rank_correlation

    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 2))
    b = a + rng.normal(0, 0.3, (300, 2))
    a[0] = b[0] = 1e6
    df = spark.createDataFrame([(i, [*map(float, p), *map(float, q)]) for i, (p, q) in enumerate(zip(a, b))], "id bigint, xy array<double>")
    i, j = np.triu_indices(300, 1)
    ranks = [pd.Series(np.hypot(*(m[i] - m[j]).T)).rank() for m in (a, b)]
    want = np.corrcoef(*ranks)[0, 1]
    got = distance_rank_correlation(df, 300, 2, tile_rows=90)
    assert got[0] == pytest.approx(1.0) and got[1] == pytest.approx(want, abs=1e-5) and want < 0.99


def test_labels_alone_take_no_pairs(spark, blobs, monkeypatch):
    x, df, d = blobs
    want = by_id(clustering.cluster(df, "x", "KMeans", 200, k=4)[0]).cluster

    def pairs(*args, **kwargs):
        raise AssertionError("pairs of rows")

    monkeypatch.setattr(neighbors, "silhouettes", pairs)
    got = by_id(clustering.labels_of(df, "x", "KMeans", 200, k=4)).cluster
    assert (got == want).all()


def test_replicate_tiles_work_in_strips(spark, monkeypatch):
    """No array of a tile has both of its blocks in full."""
    monkeypatch.setattr(qc, "SUB_ROWS", 5, raising=False)
    tiles = []
    monkeypatch.setattr(qc, "group_tiles", lambda df, group, tile, schema: tiles.append(tile) or df.sparkSession.createDataFrame([], schema))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(44, 8))
    s = spectra_of(spark, x, np.arange(8.0), pd.DataFrame({"g": ["hot"] * 44}))
    qc.replicate_consistency(s, F.col("g"))
    u = x - x.mean(axis=1, keepdims=True)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    largest = []
    real = np.triu_indices
    monkeypatch.setattr(np, "triu_indices", lambda n, k=0: largest.append(n) or real(n, k))
    for block, bj in ((np.zeros(44, dtype=int), 0), (np.arange(44) % 2, 1)):
        table = pa.table({"block": block, "bi": [0] * 44, "bj": [bj] * 44, "replicate_group": ["hot"] * 44, "u": u.tolist()})
        got = tiles[0](table).to_pylist()[0]
        r = (u @ u.T)[real(44, 1)] if bj == 0 else (u[block == 0] @ u[block == 1].T).ravel()
        assert got["pairs"] == r.size and got["total"] == pytest.approx(r.sum()) and got["lowest"] == pytest.approx(r.min())
    assert max(largest) <= 5


@pytest.mark.parametrize("fold", [4, 1024])
def test_ward_folds_copies_before_the_rounds(spark, monkeypatch, fold):
    """Forty copies of a point took forty rounds, one pair each."""
    from spectraloom.operators import ward as module

    monkeypatch.setattr(module, "FOLD_ROWS", fold)
    rounds, real = [], module.group_tiles
    monkeypatch.setattr(module, "group_tiles", lambda *a: rounds.append(1) or real(*a))
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(9, 2)), [40, 1, 30, 2, 1, 17, 1, 1, 5], axis=0)
    tree = ward(points_of(spark, x), "x", len(x), tail=12, tile_rows=64)
    link = tree.linkage().orderBy("step").toPandas()
    n = len(x)
    assert not rounds and len(link) == n - 1 and np.allclose(link.height, brute_ward(x), atol=1e-12)
    assert sorted([*link.left, *link.right]) == list(range(2 * n - 2)) and (link.right < n + link.step).all()
    assert link["size"].iloc[-1] == n
    parts = np.array(tree.labels([2, 9, 20]).toPandas().sort_values("sample_index").labels.tolist())
    assert [len(set(parts[:, i])) for i in range(3)] == [2, 9, 20]
    group = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    assert len({(a, b) for a, b in zip(group, parts[:, 1])}) == 9


def test_distance_ranks_take_strips(spark, monkeypatch):
    """A tile's distances are counted in strips, not sorted whole."""
    from spectraloom.operators import stability

    largest, real = [], stability.squared
    monkeypatch.setattr(stability, "squared", lambda a, b: largest.append(len(a) * len(b)) or real(a, b))
    monkeypatch.setattr(stability, "STRIP_ROWS", 8, raising=False)
    tiles = []

    def here(df, group, tile, schema):
        tiles.append(tile)
        t = pa.Table.from_pandas(df.toPandas()).append_column("bi", pa.array([0] * 90)).append_column("bj", pa.array([0] * 90))
        return df.sparkSession.createDataFrame(tile(t).to_pandas(), schema)

    monkeypatch.setattr(stability, "group_tiles", here)
    x = np.random.default_rng(5).normal(size=(90, 4))
    df = spark.createDataFrame([(i, [*map(float, p)]) for i, p in enumerate(x)], "id bigint, xy array<double>")
    got = stability.distance_rank_correlation(df, 90, 2, tile_rows=90)
    i, j = np.triu_indices(90, 1)
    ranks = [pd.Series(np.hypot(*(m[i] - m[j]).T)).rank() for m in (x[:, :2], x[:, 2:])]
    assert got[1] == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-5)
    assert len(tiles) == 3 and max(largest) <= 8 * 90


def test_joint_labels_return_one_packed_row_a_tile(spark):
    """A row's sums leave a tile once, not once per labeling and label."""
    rng = np.random.default_rng(5)
    x, codes = rng.normal(size=(300, 3)), rng.integers(0, 4, size=(300, 6))
    codes[:, 5] = np.where(np.arange(300) % 4 == 0, -1, codes[:, 5])
    rows = points_of(spark, x).withColumnsRenamed({"sample_index": "id"})
    given = spark.createDataFrame([(i, [None if c < 0 else str(c) for c in r]) for i, r in enumerate(codes.tolist())], "id bigint, labels array<string>")
    joined = rows.join(given, "id")
    kinds = label_sums.labels_in(joined, 6)
    coded = joined.select("id", kinds.codes("labels").alias("codes"), "x")
    parts = label_sums.tile_sums(coded, kinds, {None: list(range(6))}, 300, 100)
    counts = parts.groupBy("id").count().select("count").distinct().collect()
    assert [r["count"] for r in counts] == [3]
    got = label_sums.widths(parts, kinds).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for w in (0, 5):
        keep = codes[:, w] >= 0
        mine = got[got.labeling == w].sort_values("id").silhouette.to_numpy()
        assert np.allclose(mine, brute_silhouette(d[np.ix_(keep, keep)], codes[keep, w]))


def test_rows_that_ask_link_over_residents():
    links = np.array([[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0]], dtype=bool)
    asked, home = neighbors._linked(links)
    assert list(asked) == [0, 0, 3, -1] and list(home) == [0, 0, 2, 3]
