"""Stability of the PCA picture: across preprocessing choices and across subsamples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow_matrix import to_list_array, to_matrix
from ..functions.spectrum import affine, literal
from ..session import durable
from ..spectra import ID, Y, Profile, Spectra
from .clustering import Stability, classify
from .moments import accumulate
from .pca import (
    FoldMoments,
    PcaModel,
    center_is_last,
    cv_table,
    decompose,
    fit_pca,
    fold_moments,
    stateless,
)
from .ranks import cut_index, hash_cuts
from .recipe import Step
from .tiles import PAIR_ROWS, STRIP_ROWS, Tile, assign_blocks, group_tiles, squared

# Stability thresholds.
DISTANCE_STABLE = 0.70
GEOMETRY_HIGH, GEOMETRY_MODERATE = 0.75, 0.45
LOADING_HIGH, LOADING_MODERATE = 0.80, 0.60
SUBSAMPLE = 0.80
#: Steps of the rank table: a distance keeps its leading 16 bits, and finer ones where many are alike.
DISTANCE_BITS = 16


def planes_of(spectra: Spectra, models: Sequence[PcaModel]) -> DataFrame:
    """``(id, xy)``: PC1/PC2 of every model side by side, each scaled to unit population sd.

    One pass over the raw arrays serves all models; one aggregation gives the scales.
    """
    chains = [m.recipe.chain for m in models]
    means = [m.mean for m in models]
    axes = [m.loadings[:, :2] for m in models]

    @F.arrow_udf("array<double>")
    def project(values: pa.Array) -> pa.Array:
        raw = to_matrix(values, chains[0].width_in)
        return to_list_array(
            np.hstack([(c.apply(raw) - m) @ v for c, m, v in zip(chains, means, axes)])
        )

    raw = durable(spectra.df.select(F.col(ID).cast("bigint").alias("id"), project(F.col("y")).alias("xy")))
    width = 2 * len(models)
    stats = raw.agg(
        F.array(*[F.avg(F.get("xy", F.lit(j))) for j in range(width)]).alias("m"),
        F.array(*[F.stddev_pop(F.get("xy", F.lit(j))) for j in range(width)]).alias("s"),
    ).first()
    scale = [v if v else 1.0 for v in stats["s"]]
    return raw.select("id", affine(F.col("xy"), literal(stats["m"]), literal(scale)).alias("xy"))


def distance_rank_correlation(planes: DataFrame, n: int, width: int, tile_rows: int = PAIR_ROWS) -> list[float]:
    """Spearman correlation of pairwise distances in each plane with those of plane 0.

    ``planes`` is ``(id, xy ARRAY<DOUBLE>[2 * width])``, the planes side by side.  Distances are
    counted by their leading bits, whatever their range; where many share these, a second pass
    counts by as many further bits as the share asks for.  So a step of the rank table holds about
    1/65,536 of the pairs at most, unless they are equal to many digits, and an outlier
    takes one step and no more.  A third pass sums rank products.  No pair leaves its tile.
    """
    blocked = assign_blocks(planes, "id", n, tile_rows)

    def pair_distances(t: Tile, w: int) -> Iterator[np.ndarray]:
        """Every distance of a tile once, in strips that stay in a core's cache."""
        x = t.x[:, 2 * w : 2 * w + 2]
        left, right = x[t.left], x[t.right]
        for at in range(0, len(left), STRIP_ROWS):
            part = left[at : at + STRIP_ROWS]
            d = np.sqrt(squared(part, right[at:] if t.same else right))
            yield d[np.arange(d.shape[1])[None, :] > np.arange(len(part))[:, None]] if t.same else d.ravel()

    steps = 1 << DISTANCE_BITS

    def leading(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first bits of every distance, and all of them; both in the order of the distances."""
        bits = d.view(np.uint64)
        return (bits >> np.uint64(64 - DISTANCE_BITS)).astype(np.int64), bits

    def counted(bins, most: int) -> np.ndarray:
        def count(table: pa.Table) -> pa.Table:
            t = Tile(table, "xy")
            ws, bs, cs = [], [], []
            for w in range(width):
                total = np.zeros(most, dtype=np.int64)
                for d in pair_distances(t, w):
                    total += np.bincount(bins(d, w), minlength=most)
                used = np.flatnonzero(total)
                c = total[used]
                ws.append(np.full(len(used), w))
                bs.append(used)
                cs.append(c)
            return pa.table(
                {
                    "w": pa.array(np.concatenate(ws), pa.int32()),
                    "b": pa.array(np.concatenate(bs), pa.int32()),
                    "c": pa.array(np.concatenate(cs), pa.int64()),
                }
            )

        parts = group_tiles(blocked, [], count, "w int, b int, c bigint").groupBy("w", "b").agg(F.sum("c").alias("c"))
        return parts.toPandas().to_numpy(dtype=np.int64)  # at most width x 196,608 rows

    coarse = np.zeros((width, steps))
    for w, b, c in counted(lambda d, w: leading(d)[0], steps):
        coarse[w, b] = c
    share = coarse / np.maximum(coarse.sum(axis=1, keepdims=True), 1) * steps
    further = np.where(share > 1, np.ceil(np.log2(np.maximum(share, 1))), 0).astype(np.uint64)
    sizes = np.where(coarse > 0, 2 ** further.astype(np.int64), 1)
    first = np.cumsum(sizes, axis=1) - sizes
    table = planes.sparkSession.sparkContext.broadcast((further, first))  # width x 65,536 numbers, twice

    def bins(d: np.ndarray, w: int) -> np.ndarray:
        head, bits = leading(d)
        more, start = table.value[0][w][head], table.value[1][w][head]
        rest = (bits << np.uint64(DISTANCE_BITS)) >> np.uint64(1) >> (np.uint64(63) - more)
        return start + np.where(more > 0, rest, 0).astype(np.int64)

    finest = int(sizes.sum(axis=1).max())
    counts = np.zeros((width, finest))
    for w, b, c in counted(bins, finest):
        counts[w, b] = c
    rank = np.cumsum(counts, axis=1) - counts + (counts + 1) / 2.0
    pairs = counts.sum(axis=1)
    centered = rank - (pairs[:, None] + 1) / 2.0
    scale = np.sqrt((counts * centered**2).sum(axis=1))
    lookup = planes.sparkSession.sparkContext.broadcast(centered)  # width x 196,608 doubles at most

    def product(table: pa.Table) -> pa.Table:
        t, ranks = Tile(table, "xy"), lookup.value
        sums = np.zeros(width)
        for planes_ in zip(*[pair_distances(t, w) for w in range(width)]):
            of = [ranks[w][bins(d, w)] for w, d in enumerate(planes_)]
            sums += [float(of[0] @ r) for r in of]
        return pa.table({"w": pa.array(np.arange(width), pa.int32()), "s": pa.array(sums)})

    sums = group_tiles(blocked, [], product, "w int, s double").groupBy("w").agg(F.sum("s").alias("s")).collect()
    by_plane = {r["w"]: r["s"] for r in sums}
    return [
        by_plane[w] / (scale[0] * scale[w]) if scale[0] > 0 and scale[w] > 0 else math.nan for w in range(width)
    ]


def preprocessing_stability(spectra: Spectra, comparisons: Sequence[dict], n: int) -> Stability:
    """Does the sample geometry survive other reasonable recipes?  First entry is the reference."""
    planes = planes_of(spectra, [c["model"] for c in comparisons])
    rho = distance_rank_correlation(planes, n, len(comparisons))
    table = pd.DataFrame(
        {
            "name": [c["name"] for c in comparisons],
            "distance_structure_correlation": rho,
            "Q2_X": [c["Q2_X"] for c in comparisons],
            "group_separation": [c["group_separation"] for c in comparisons],
            "uses_snv": [c["uses_snv"] for c in comparisons],
        }
    )
    finite = table.distance_structure_correlation.dropna()
    stable = int((finite >= DISTANCE_STABLE).sum())
    score = stable / len(finite) if len(finite) else math.nan
    level = classify(score, GEOMETRY_HIGH, GEOMETRY_MODERATE)
    return Stability(
        table, score, level,
        f"PCA geometry is {level} across preprocessing choices: {stable} of {len(finite)} recipes keep the "
        f"selected model's pairwise-distance pattern at correlation >= {DISTANCE_STABLE:.2f}.",
    )


def resampling_stability(
    spectra: Spectra,
    steps: Sequence[Step],
    model: PcaModel,
    profile: Profile,
    resamples: int = 8,
    component_resamples: int = 4,
    seed: int = 42,
) -> tuple[Stability, list[int]]:
    """Loading, variance and component-count stability over 80% subsamples without replacement.

    Subsamples are exact-size hash-order prefixes.  For trailing mean-center recipes on
    complete data every subsample (and every fold of the component-count resamples) is a key
    of one scan; a row is read once however many subsamples it belongs to.
    """
    n = profile.n
    if n < 6:
        return Stability(pd.DataFrame(), math.nan, "unavailable", "Too few samples for PCA resampling stability."), []
    take = min(max(4, round(n * SUBSAMPLE)), n)
    count = model.components
    folds = min(3, take)
    max_pc = min(max(3, count + 3), 10, take - 2, spectra.width)
    fits: list[tuple[np.ndarray, np.ndarray]] = []
    choices: list[int] = []
    salts = [f"{seed}:{r}" for r in range(resamples + component_resamples)]
    # blocks 0..folds-1 are the subsample's folds, the last block is left out
    ends = [take * f // folds for f in range(1, folds + 1)]
    cuts = hash_cuts(spectra.df.select(ID), ID, salts, lambda _: ends, n=n)
    if profile.incomplete == 0 and center_is_last(steps):
        chain = stateless(spectra.axis, steps)
        pivot = chain.apply(profile.reference[None, :])[0]
        blocks = F.array(*[cut_index(ID, salt, cuts[(salt, None)]) for salt in salts])
        keys = F.transform(blocks, lambda b, r: F.when(b < folds, r * folds + b))
        parts = accumulate(spectra.df.select(Y, keys.alias("key")), [chain], [pivot], key="key")
        for r in range(resamples + component_resamples):
            pieces = [parts[(0, r * folds + f)] for f in range(folds)]
            whole = pieces[0]
            for p in pieces[1:]:
                whole = whole + p
            if r < resamples:
                values, vectors = decompose(whole.scatter())
                fits.append((vectors[:, :count], values[:count] / values.sum()))
            elif max_pc >= 2:
                choices.append(cv_table([FoldMoments(whole - p, p, True) for p in pieces], max_pc, "K-fold")[1])
    else:
        for r in range(resamples + component_resamples):
            block = cut_index(ID, salts[r], cuts[(salts[r], None)])
            marked = spectra.df.withColumn("fold", block).filter(F.col("fold") < folds)
            part = Spectra(marked, spectra.axis, spectra.meta)
            facts = Profile(take, profile.incomplete, profile.reference)
            if r < resamples:
                fit = fit_pca(part, steps, count, facts)
                fits.append((fit.loadings, fit.ratio))
            elif max_pc >= 2:
                moments = fold_moments(part, [steps], folds, facts)[0]
                choices.append(cv_table(moments, max_pc, "K-fold")[1])
    rows = []
    for k in range(count):
        match = [abs(np.corrcoef(model.loadings[:, k], v[:, k])[0, 1]) for v, _ in fits if v.shape[1] > k]
        match = [m for m in match if math.isfinite(m)]
        share = [float(e[k]) for _, e in fits if len(e) > k]
        rows.append(
            {
                "PC": k + 1,
                "median_loading_abs_correlation": float(np.median(match)) if match else math.nan,
                "explained_variance_mean": float(np.mean(share)) if share else math.nan,
                "explained_variance_sd": float(np.std(share, ddof=1)) if len(share) > 1 else 0.0 if share else math.nan,
                "reference_explained_variance": float(model.ratio[k]),
            }
        )
    table = pd.DataFrame(rows)
    leading = table.median_loading_abs_correlation.head(3).dropna()
    score = float(leading.mean()) if len(leading) else math.nan
    level = classify(score, LOADING_HIGH, LOADING_MODERATE)
    chosen = (
        f"Resampled PCA selected {min(choices)}-{max(choices)} components (median {np.median(choices):.1f})."
        if choices
        else "Component-count resampling was unavailable."
    )
    return Stability(table, score, level, f"Loading stability is {level} (score {score:.2f}). {chosen}"), choices
