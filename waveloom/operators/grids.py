"""Grids of k-means models on one copy of the data: every pass over the blocks serves all models at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pick_first, random_hex
from . import blocks as B
from . import kernels as K
from .landing import land

_ROWS = 512  # rows of a block that are compared with all centres together
_BLOCK = 1024  # rows of a block of a grid: many blocks, so that the rounds spread over the cluster


class Models:
    """Centres of many models, stacked by dimension so that one product compares a row with all of them.

    ``specs`` lists (dims, k) of each model; a model reads the first ``dims`` coordinates.
    """

    def __init__(self, specs: Sequence[tuple[int, int]], centres: Sequence[np.ndarray]):
        self.specs, self.centres = list(specs), list(centres)
        self.by_dim = {d: [i for i, s in enumerate(self.specs) if s[0] == d] for d in sorted({s[0] for s in self.specs})}
        self.by_shape = {shape: [i for i, s in enumerate(self.specs) if s == shape] for shape in dict.fromkeys(self.specs)}

    def labels(self, m: np.ndarray):
        """For each dimension, its models; and per model the nearest centre of each row with the squared distance (first of equals)."""
        for d, some in self.by_dim.items():
            x = m[:, :d]
            c = np.concatenate([self.centres[i] for i in some])
            far = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0.0)
            at = 0
            for i in some:
                own = far[:, at: at + self.specs[i][1]]
                near = own.argmin(1)
                yield i, x, near, own[np.arange(len(x)), near]
                at += self.specs[i][1]


    def add_sums(self, m: np.ndarray, out: list[np.ndarray]) -> None:
        """Add the sums of coordinates and the counts of every cluster; models of one shape are taken together, by centre, model and row."""
        for (d, k), some in self.by_shape.items():
            c = np.stack([self.centres[i] for i in some], 1).reshape(-1, d)
            x = np.column_stack([m[:, :d], np.ones(len(m))])
            # squared distances less the square of the row, which no comparison needs
            far = (np.column_stack([-2 * c, (c * c).sum(1)]) @ x.T).reshape(k, len(some), len(m))
            least, near = far[0].copy(), np.zeros(far.shape[1:], np.int16)
            for j in range(1, k):
                np.copyto(near, j, where=far[j] < least)
                np.minimum(least, far[j], out=least)
            hot = near[None] == np.arange(k, dtype=np.int16)[:, None, None]
            s = (hot.reshape(-1, len(m)).astype(float) @ x).reshape(k, len(some), d + 1)
            for j, i in enumerate(some):
                out[i].reshape(k, d + 1)[:] += s[:, j]


def _pass(z: DataFrame, sizes: Sequence[int], body) -> list[np.ndarray]:
    """Sum over all rows of the arrays that ``body(rows, out)`` adds to; ``sizes`` are their lengths. Each task adds up its own blocks
    first; the parts are added position by position, and the driver gets one array whose length is that of the models. Arrays of up to
    1 MB are sent as they are, one per task, which saves a shuffle in every round."""
    cuts = np.cumsum(sizes)[:-1]

    def run(batches):
        total = np.zeros(int(sum(sizes)))
        out = np.split(total, cuts)
        for batch in batches:
            for cell in batch.column(0):
                m = cell.values
                m = m.flatten().to_numpy(zero_copy_only=False).reshape(len(m), -1)
                for lo in range(0, len(m), _ROWS):
                    body(m[lo: lo + _ROWS], out)
        yield pa.RecordBatch.from_pydict({"a": pa.array([total], pa.list_(pa.float64()))})

    parts = z.select("m").mapInArrow(run, "a array<double>")
    if sum(sizes) <= 1 << 17:
        return np.split(np.sum([np.asarray(v) for v in parts.toArrow().column("a").to_pylist()], axis=0), cuts)
    got = parts.select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(int(sum(sizes)))
    total[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return np.split(total, cuts)


def fit_models(z: DataFrame, specs: Sequence[tuple[int, int]], first: Sequence[np.ndarray], tol: float = 4e-3) -> tuple[list[np.ndarray], np.ndarray]:
    """Centres and inertia of every model from its ``first`` centres on, by Lloyd rounds over blocks ``z``.

    A round is one pass for all models that still move; a model is settled when no coordinate of its centres moves by more than ``tol``.
    An empty cluster keeps its centre. The number of rounds is not limited: no round raises the inertia, so all models settle.
    """
    spark = z.sparkSession
    centres = [np.asarray(c, float) for c in first]
    moving = list(range(len(specs)))
    while moving:
        box = spark.sparkContext.broadcast(Models([specs[i] for i in moving], [centres[i] for i in moving]))

        def add(rows, out, box=box):
            box.value.add_sums(rows, out)

        sums = _pass(z, [specs[i][1] * (specs[i][0] + 1) for i in moving], add)
        left = []
        for i, s in zip(moving, sums):
            s = s.reshape(specs[i][1], -1)
            new = np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), centres[i])
            if np.abs(new - centres[i]).max() > tol:
                left.append(i)
            centres[i] = new
        moving = left
    box = spark.sparkContext.broadcast(Models(specs, centres))

    def cost(rows, out):
        for i, _, _, far in box.value.labels(rows):
            out[i][0] += far.sum()

    return centres, np.array([v[0] for v in _pass(z, [1] * len(specs), cost)])


def starting(drawn: np.ndarray, d: int, k: int, starts: int) -> list[np.ndarray]:
    """First centres of every start: start s takes the drawn rows s, s + starts, ...; with few rows they repeat."""
    return [drawn[[(s + p * starts) % len(drawn) for p in range(k)], :d] for s in range(starts)]


def fit_one(z: DataFrame, k: int, *, starts: int, seed: int) -> DataFrame:
    """(model, inertia): k-means of blocks ``z`` without keys, the best of ``starts`` starts; the same draw as ``blocks.kmeans_models``.

    A round is one job that returns sums of the size of the models, and a start that has settled takes part no more.
    """
    rows = z.select(F.explode(F.arrays_zip("ids", "m")).alias("z")).select(F.to_json("z.ids").alias("_id"), F.col("z.m").alias("x"))
    drawn = np.array([r["x"] for r in pick_first(rows, [], random_hex(F.lit(int(seed)), "_id"), k=k * starts, rank="_r").orderBy("_r").collect()])  # k x starts rows
    d = drawn.shape[1]
    centres, cost = fit_models(z, [(d, k)] * starts, starting(drawn, d, k, starts))
    best = int(np.argmin(cost))
    return land(z.sparkSession.createDataFrame([(centres[best].ravel().tolist(), float(cost[best]))], "model array<double>, inertia double"))


def _spread(z: DataFrame, models: Models, pairs: Sequence[tuple[int, int]]) -> tuple[list, list, list[np.ndarray]]:
    """Per model: cluster sizes, (Calinski-Harabasz, Davies-Bouldin); per pair of models: the table of common counts."""
    specs = models.specs
    box = z.sparkSession.sparkContext.broadcast((models, list(pairs)))

    def means(rows, out):
        found = {}
        m, pairs = box.value
        for i, x, near, _ in m.labels(rows):
            d, k = m.specs[i]
            hot = (near[:, None] == np.arange(k)).astype(float)
            s = out[i].reshape(k, d + 1)
            s[:, :d] += hot.T @ x
            s[:, d] += hot.sum(0)
            found[i] = near
        for n, (a, b) in enumerate(pairs):
            t = out[len(m.specs) + n]
            t += np.bincount(found[a] * m.specs[b][1] + found[b], minlength=len(t))

    got = _pass(z, [k * (d + 1) for d, k in specs] + [specs[a][1] * specs[b][1] for a, b in pairs], means)
    sizes, mean = [], []
    for (d, k), g in zip(specs, got):
        g = g.reshape(k, d + 1)
        sizes.append(g[:, d])
        mean.append(g[:, :d] / np.maximum(g[:, d:], 1))
    box2 = z.sparkSession.sparkContext.broadcast(mean)

    def spread(rows, out):
        m, mean = box.value[0], box2.value
        for i, x, near, _ in m.labels(rows):
            q = ((x - mean[i][near]) ** 2).sum(1)
            k = m.specs[i][1]
            out[i][0] += q.sum()
            out[i][1:] += np.bincount(near, weights=np.sqrt(q), minlength=k)

    values = []
    for (d, k), n, c, s in zip(specs, sizes, mean, _pass(z, [1 + k for _, k in specs], spread)):
        some = n > 0
        total, here = n.sum(), int(some.sum())
        middle = (n[:, None] * c).sum(0) / total
        between, within = (n * ((c - middle) ** 2).sum(1)).sum(), s[0]
        width = (s[1:] / np.maximum(n, 1))[some]
        gap = np.sqrt(((c[some][:, None] - c[some][None]) ** 2).sum(2))
        with np.errstate(divide="ignore", invalid="ignore"):
            worst = np.where(gap > 0, (width[:, None] + width[None]) / gap, 0.0).max(1) if here else np.zeros(1)
        ch = between / (here - 1) / (within / (total - here)) if here > 1 and within > 0 and total > here else 1.0
        values.append((ch, worst.mean()))
    return sizes, values, [t.reshape(specs[a][1], specs[b][1]) for t, (a, b) in zip(got[len(specs):], pairs)]


def _agreement(t: np.ndarray) -> float:
    """Adjusted Rand index of a table of common counts."""
    pairs = lambda v: (v * (v - 1) / 2).sum()
    both, a, b = pairs(t), pairs(t.sum(1)), pairs(t.sum(0))
    expected = a * b / max(pairs(np.array([t.sum()])), 1)
    return 1.0 if (a + b) / 2 == expected else float((both - expected) / ((a + b) / 2 - expected))


def silhouettes(rows: DataFrame, models: Models, ids: Sequence[str], x: str = "x", block: int = 2048) -> np.ndarray:
    """Mean silhouette of every model over ``rows``, exact: each pair of blocks gives the sums of distances to all clusters of all models of a
    dimension by one distance matrix and one product."""
    from .clustering import _block_pairs, _dense_dist

    bl = land(B.pack(rows.select(*ids, x), [], ids, x, block).select("b", "m"))
    specs = models.specs
    width = sum(k for _, k in specs)
    box = rows.sparkSession.sparkContext.broadcast(models)

    def hots(m):
        """Cluster indicators of all models side by side, grouped by dimension."""
        out = {}
        for i, _, near, _ in box.value.labels(m):
            d, k = box.value.specs[i]
            out.setdefault(d, []).append(near[:, None] == np.arange(k))
        return {d: np.concatenate(v, 1).astype(float) for d, v in out.items()}

    @F.pandas_udf("array<double>")
    def sums(m: pd.Series, o: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(m, o):
            a, b = K.matrix(a), K.matrix(b)
            hot = hots(b)
            s = np.concatenate([_dense_dist(a[:, :d], b[:, :d]) @ h for d, h in hot.items()], 1)
            out.append(np.concatenate([s.ravel(), *[h.sum(0) for h in hot.values()]]))
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def value(m: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for a, v in zip(m, t):
            a, v = K.matrix(a), np.asarray(v, float)
            s, n = v[: len(a) * width].reshape(len(a), width), v[len(a) * width:]
            res, at, row = np.zeros(len(specs) + 1), 0, np.arange(len(a))
            res[-1] = len(a)
            for i, _, near, _ in box.value.labels(a):
                k = box.value.specs[i][1]
                c, t_ = n[at: at + k], s[:, at: at + k]
                own = t_[row, near] / np.maximum(c[near] - 1, 1)
                mean = np.where(c > 0, t_ / np.maximum(c, 1), np.inf)
                mean[row, near] = np.inf
                other = mean.min(1)
                with np.errstate(invalid="ignore"):
                    sil = np.where((c[near] > 1) & np.isfinite(other), (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
                res[i] = sil.sum()
                at += k
            out.append(res)
        return pd.Series(out)

    p = _block_pairs(bl, ["m"], both=True).select(F.col("b"), sums("l_m", "r_m").alias("sums"))
    total = B.sum_arrays(p, ["b"], "sums")
    got = np.array(B.sum_arrays(bl.join(total, "b").select(value("m", "sums").alias("v")), [], "v").first()[0])  # one number per model
    return got[:-1] / got[-1]


def grid_search(train: DataFrame, dims: Sequence[int], ks: Sequence[int], seeds: Sequence[int], ids: Sequence[str], x: str = "x", starts: int = 20, sample: int | None = 5000) -> DataFrame:
    """CLU03: per (dims, k), mean and sample std over the seeds of silhouette, Calinski-Harabasz, Davies-Bouldin and inertia, mean smallest and
    largest cluster share, mean and std of the agreement of all pairs of seeds, and the explained variance.

    One scaler and one set of components at the largest dimension serve all settings (smaller ones are their first columns). All settings,
    seeds and starts are fitted together on one copy of the blocks. ``dims`` is limited to rows and features, k to rows - 1; settings with fewer than two
    clusters are left out. Silhouettes are those of the ``sample`` rows with the smallest keyed hash of each seed, a bounded documented
    sample (None: of all rows, quadratic); all else covers all rows.
    """
    from .clustering import _clean

    spark = train.sparkSession
    b = land(B.pack(_clean(train, x).select(*ids, x), [], ids, x, _BLOCK))
    n, features = b.agg(F.sum(F.size("m")), F.max(F.size(F.get("m", 0)))).first()
    most = min(max(dims), n or 0, features or 0)
    settings = [(d, k) for d in (min(v, most) for v in dims) for k in (min(v, (n or 0) - 1) for v in ks) if k >= 2]
    schema = ("dims int, k int, explained_variance double, silhouette_mean double, silhouette_std double, calinski_harabasz_mean double, calinski_harabasz_std double, davies_bouldin_mean double, "
              "davies_bouldin_std double, inertia_mean double, inertia_std double, min_share_mean double, max_share_mean double, ari_mean double, ari_std double")
    if not settings:
        return spark.createDataFrame([], schema)
    base = B.pca_models(b, [], most)
    share = [r["cumulative"] for r in B.explained(base, [], most).orderBy("component").collect()]
    # the rounds cost far more than the bytes read say: a fixed number of files, so that all cores take part
    z = land(B.project(b, base, [], most).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "b"))

    # starts: rows with the smallest keyed hash of each seed
    rows = land(B.unpack(z, [], ["m"]).withColumnRenamed("m", "x").withColumn("_id", F.to_json(F.struct(*ids))))
    largest = max(k for _, k in settings)
    specs, first = [], []
    for seed in seeds:
        drawn = np.array([r["x"] for r in pick_first(rows, [], random_hex(F.lit(int(seed)), "_id"), k=largest * starts, rank="_r").orderBy("_r").collect()])  # bounded by the settings
        for d, k in settings:
            specs += [(d, k)] * starts
            first += starting(drawn, d, k, starts)
    centres, cost = fit_models(z, specs, first)
    best = [int(np.argmin(cost[g: g + starts])) + g for g in range(0, len(specs), starts)]  # by seed, then setting
    models = Models([specs[i] for i in best], [centres[i] for i in best])
    m = len(settings)
    pairs = [(a * m + g, c * m + g) for g in range(m) for a in range(len(seeds)) for c in range(a + 1, len(seeds))]
    sizes, values, tables = _spread(z, models, pairs)
    sil = []
    for s, seed in enumerate(seeds):
        some = rows if sample is None or n <= sample else pick_first(rows, [], random_hex(F.lit(int(seed)), F.lit("silhouette"), "_id"), k=sample)
        sil.append(silhouettes(some, Models(models.specs[s * m: s * m + m], models.centres[s * m: s * m + m]), ids))
    out = []
    each = lambda v: (float(np.mean(v)), float(np.std(v, ddof=1)) if len(v) > 1 else None)
    for g, (d, k) in enumerate(settings):
        own = [s * m + g for s in range(len(seeds))]
        ari = [_agreement(t) for t, (a, _) in zip(tables, pairs) if a % m == g]
        out.append((d, k, share[d - 1], *each([v[g] for v in sil]), *each([values[i][0] for i in own]), *each([values[i][1] for i in own]), *each([cost[best[i]] for i in own]),
                    float(np.mean([sizes[i].min() / n for i in own])), float(np.mean([sizes[i].max() / n for i in own])), float(np.mean(ari)) if ari else None, float(np.std(ari)) if ari else None))
    return spark.createDataFrame(out, schema)
