"""Models per key (one subject, or the whole table) on rows packed into bounded blocks.

Vectors of a key are packed into blocks of a few thousand rows, so a key of any size is many blocks.
Passes over the data are Arrow functions on whole blocks that return small arrays; these are summed
per key, and the tiny model (moments, components, centroids) is joined back to the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pick_first, random_hex
from . import kernels as K
from .landing import land
from .ordered import attach

BLOCK = 4096


def pack(rows: DataFrame, keys: Sequence[str], ids: Sequence[str], x: str = "x", block: int = BLOCK, extra: Sequence[str] = ()) -> DataFrame:
    """(keys.., b, ids, m): blocks of at most a few thousand vectors of one key."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_nb"))
    r = _join(rows, n, keys)
    r = r.withColumn("b", F.pmod(F.xxhash64(*ids), F.col("_nb")))
    g = r.groupBy(*keys, "b").agg(F.sort_array(F.collect_list(F.struct(*ids, *extra, F.col(x).alias("x")))).alias("_s"))
    return g.select(*keys, "b", F.transform("_s", lambda s: F.struct(*[s[i].alias(i) for i in (*ids, *extra)])).alias("ids"), F.col("_s.x").alias("m"))


def unpack(blocks: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Back to rows: ids and one value per row from each array column in ``cols``."""
    z = blocks.select(*keys, F.explode_outer(F.arrays_zip("ids", *cols)).alias("z"))
    return z.select(*keys, "z.ids.*", *[F.col(f"z.{k}").alias(k) for k in cols])


def sum_arrays(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Element-wise sum of equally long arrays per key."""
    e = df.select(*keys, F.posexplode_outer(col).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v"))
    return e.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_s")).select(*keys, F.col("_s._v").alias(col))


def _join(blocks: DataFrame, model: DataFrame, keys: Sequence[str]) -> DataFrame:
    return attach(blocks, model, keys)


def _per_block(fn, returns="array<double>"):
    """Arrow function of (block matrix, model array...)."""

    @F.pandas_udf(returns)
    def one(m: pd.Series) -> pd.Series:
        return pd.Series([fn(K.matrix(v)) for v in m])

    @F.pandas_udf(returns)
    def two(m: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([fn(K.matrix(v), np.asarray(p, float)) for v, p in zip(m, a)])

    return lambda *cols: (one if len(cols) == 1 else two)(*cols)


def moments(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., moments): n, sums and sums of products of the vectors."""
    f = _per_block(lambda m: np.concatenate([[len(m)], m.sum(0), (m.T @ m).ravel()]))
    return sum_arrays(blocks.select(*keys, f("m").alias("moments")), keys, "moments")


def _split(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    d = int((-1 + np.sqrt(1 + 4 * (len(p) - 1))) / 2 + 0.5)
    n = p[0]
    return n, p[1:1 + d] / n, p[1 + d:].reshape(d, d) / n


def pca_models(blocks: DataFrame, keys: Sequence[str], dims: int, standardize: bool = True) -> DataFrame:
    """(keys.., model): mean, scale and up to ``dims`` components (signs fixed) with explained shares, flattened.

    Computed from the summed moments: the matrix is features x features whatever the number of rows.
    """

    @F.pandas_udf("array<double>")
    def solve(p: pd.Series) -> pd.Series:
        out = []
        for v in p:
            n, mu, second = _split(np.asarray(v, float))
            cov = second - np.outer(mu, mu)
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            sd = np.where(sd < 1e-8, 1.0, sd) if standardize else np.ones(len(mu))
            val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
            order = np.argsort(-val, kind="stable")
            keep = min(dims, len(mu), max(int(n), 1))
            comp = vec[:, order[:keep]].T
            comp = comp * np.sign(comp[np.arange(keep), np.abs(comp).argmax(1)])[:, None]
            full = np.zeros((dims, len(mu)))
            full[:keep] = comp
            share = np.zeros(dims)
            share[:keep] = np.maximum(val[order[:keep]], 0) / max(np.maximum(val, 0).sum(), 1e-300)
            out.append(np.concatenate([mu, sd, share, full.ravel()]))
        return pd.Series(out)

    return land(moments(blocks, keys).select(*keys, solve("moments").alias("model")))


def explained(models: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Explained share and cumulative share per component."""
    d = F.floor((F.size("model") - dims) / (dims + 2))
    s = F.slice("model", (2 * d + 1).cast("int"), dims)
    cum = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda k: F.aggregate(F.slice(s, 1, k), F.lit(0.0), lambda a, v: a + v))
    return models.select(*keys, F.posexplode(F.arrays_zip(s.alias("share"), cum.alias("cumulative"))).alias("component", "z")).select(*keys, "component", "z.share", "z.cumulative")


def project(blocks: DataFrame, models: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Replace the vectors of blocks by their component scores."""

    def fn(m, p):
        d = m.shape[1]
        return ((m - p[:d]) / p[d:2 * d] @ p[2 * d + dims:].reshape(dims, d).T).tolist()

    return _join(blocks, models, keys).withColumn("m", _per_block(fn, "array<array<double>>")("m", "model")).drop("model")


def scale(blocks: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the vectors of blocks by (x - mean) / population std of the model."""

    def fn(m, p):
        d = m.shape[1]
        return ((m - p[:d]) / p[d:2 * d]).tolist()

    return _join(blocks, models, keys).withColumn("m", _per_block(fn, "array<array<double>>")("m", "model")).drop("model")


def _squares(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, from products."""
    return np.maximum((m * m).sum(1)[:, None] + (c * c).sum(1) - 2 * m @ c.T, 0.0)


def kmeans_models(blocks: DataFrame, keys: Sequence[str], k: int | str, *, starts: int = 20, tol: float = 4e-3, seed: int | str = 42) -> DataFrame:
    """(keys.., model, inertia): Lloyd's algorithm for every key at once; ``k`` and ``seed`` may name key columns.

    ``starts`` sets of k rows with the smallest keyed hash begin in parallel; the set of least inertia wins. A round is one pass
    over the blocks and one sum of small arrays; the centroids are written down between rounds. A set of which no coordinate
    would move by more than ``tol`` stays where it is; rounds go on until all sets of all keys stay. Their number is not limited:
    no round raises the inertia, so all sets settle.
    """
    size = F.col(k) if isinstance(k, str) else F.lit(k)
    salt = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    largest = blocks.agg(F.max(k)).first()[0] or 1 if isinstance(k, str) else k
    rows = blocks.select(*keys, F.explode(F.arrays_zip("ids", "m")).alias("z")).select(*keys, F.to_json("z.ids").alias("_id"), F.col("z.m").alias("x"))
    first = pick_first(rows, list(keys), random_hex(salt, "_id"), k=largest * starts, rank="_r")
    got = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_r", "x"))).alias("_s"))

    # start s takes the drawn rows s, s + starts, ...; with few rows they repeat
    pick = F.flatten(F.transform(F.sequence(F.lit(0), size * starts - 1), lambda p: F.get("_s.x", F.pmod(F.floor(p / size) + F.pmod(p, size) * starts, F.size("_s")).cast("int"))))
    cent = land(got.select(*keys, pick.alias("model")))

    def step(m, p):
        d = m.shape[1]
        c = p.reshape(starts, -1, d)
        d2 = _squares(m, c.reshape(-1, d)).reshape(len(m), starts, -1)
        a, best = d2.argmin(2), d2.min(2)
        out = np.zeros((starts, c.shape[1], d + 1))
        for s in range(starts):
            np.add.at(out[s, :, :d], a[:, s], m)
            out[s, :, d] = np.bincount(a[:, s], minlength=c.shape[1])
        return np.concatenate([out.ravel(), best.sum(0)])

    @F.pandas_udf("array<double>")
    def update(old: pd.Series, sums: pd.Series) -> pd.Series:
        res = []
        for o, t in zip(old, sums):
            o, t = np.asarray(o, float), np.asarray(t, float)
            groups = len(t) - starts - len(o)  # one count per centroid besides its coordinates
            body = t[:-starts].reshape(groups, -1)
            n, o = body[:, -1:], o.reshape(groups, -1)
            new = np.where(n > 0, body[:, :-1] / np.maximum(n, 1), o)
            stays = np.abs(new - o).reshape(starts, -1).max(1) <= tol
            res.append(np.where(np.repeat(stays, groups // starts)[:, None], o, new).ravel())
        return pd.Series(res)

    @F.pandas_udf("array<double>")
    def best(old: pd.Series, sums: pd.Series) -> pd.Series:
        res = []
        for o, t in zip(old, sums):
            t = np.asarray(t, float)[-starts:]
            res.append(np.append(np.asarray(o, float).reshape(starts, -1)[int(np.argmin(t))], t.min()))
        return pd.Series(res)

    f = _per_block(step)
    diff = F.zip_with("model", "next", lambda p, q: F.abs(p - q))
    settled = False
    while True:
        sums = sum_arrays(_join(blocks, cent, keys).select(*keys, f("m", "model").alias("sums")), keys, "sums")
        if settled:
            break
        moved = land(_join(cent, sums, keys).select(*keys, "model", update("model", "sums").alias("next")))
        settled = (moved.agg(F.max(F.array_max(diff))).first()[0] or 0.0) == 0.0
        cent = moved.select(*keys, F.col("next").alias("model"))
    done = _join(cent, sums, keys).select(*keys, best("model", "sums").alias("_m"))
    return land(done.select(*keys, F.slice("_m", F.lit(1), F.size("_m") - 1).alias("model"), F.element_at("_m", -1).alias("inertia")))


def distances(blocks: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``distances`` to the blocks: by row, the distance to every centre of the key's model."""
    fn = lambda m, p: np.sqrt(_squares(m, p.reshape(-1, m.shape[1]))).tolist()
    return _join(blocks, models.select(*keys, "model"), keys).withColumn("distances", _per_block(fn, "array<array<double>>")("m", "model")).drop("model")


def assign(blocks: DataFrame, models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``cluster`` and ``distance`` to the blocks (arrays by row): the nearest centre, the first of equally near ones."""
    d = distances(blocks, models, keys)
    low = F.transform("distances", F.array_min)
    near = F.transform("distances", lambda v: F.array_position(v, F.array_min(v)) - 1)
    return d.withColumns({"cluster": near, "distance": low}).drop("distances")


def kmeans(blocks: DataFrame, keys: Sequence[str], k: int, *, starts: int = 20, tol: float = 4e-3, seed: int = 42) -> DataFrame:
    """``kmeans_models`` and ``assign`` on the same blocks."""
    blocks = land(blocks)
    return assign(blocks, kmeans_models(blocks, keys, k, starts=starts, tol=tol, seed=seed), keys)


# ---- isolation forest ---------------------------------------------------------------------------

def _c(n):
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, tree: np.ndarray, trees: int, limit: int, rng: np.random.Generator) -> np.ndarray:
    """All trees of one forest level by level: rows (feature or -1, cut or path length, left, right); row t is the root of tree t."""
    nodes = np.column_stack([np.full(trees, -1.0), np.zeros(trees), np.zeros(trees), np.zeros(trees)])
    at = tree.astype(int)
    for depth in range(limit + 1):
        if not len(x):
            break
        order = np.argsort(at, kind="stable")
        x, at = x[order], at[order]
        ids, first, count = np.unique(at, return_index=True, return_counts=True)
        lo, hi = np.minimum.reduceat(x, first, axis=0), np.maximum.reduceat(x, first, axis=0)
        can = hi > lo
        split = can.any(1) & (depth < limit)
        nodes[ids[~split], 1] = depth + _c(count[~split])
        f = np.where(can, rng.random(can.shape), -1.0).argmax(1)
        k = np.arange(len(ids))
        cut = lo[k, f] + rng.random(len(ids)) * (hi[k, f] - lo[k, f])
        n = int(split.sum())
        left = np.zeros(len(ids), int)
        left[split] = len(nodes) + 2 * np.arange(n)
        nodes[ids[split]] = np.column_stack([f[split], cut[split], left[split], left[split] + 1])
        nodes = np.concatenate([nodes, np.column_stack([np.full(2 * n, -1.0), np.full(2 * n, depth + 1.0), np.zeros(2 * n), np.zeros(2 * n)])])
        of = np.repeat(k, count)
        stay = split[of]
        x, of = x[stay], of[stay]
        at = left[of] + (x[np.arange(len(x)), f[of]] >= cut[of])
    return nodes


def isolation_forest(blocks: DataFrame, keys: Sequence[str], *, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest per key: adds ``iforest_score`` (minus the anomaly score, higher is cleaner) by row to the blocks.

    A row joins a tree with probability sample / n by a keyed hash, so a key contributes about trees x sample rows to its forest,
    however many it has. The forest is joined to blocks, not to rows.
    """
    blocks = land(blocks)
    rows = blocks.select(*keys, F.explode(F.arrays_zip("ids", "m")).alias("z")).select(*keys, F.to_json("z.ids").alias("_id"), F.col("z.m").alias("x"))
    n = blocks.groupBy(*keys).agg(F.sum(F.size("m")).alias("_n"))
    r = _join(rows, n, keys)
    share = F.lit(float(sample)) / F.col("_n")
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("_id", t, F.lit(seed)), F.lit(1 << 30)) < share * float(1 << 30))
    s = r.select(*keys, "_id", "_n", "x", F.explode(mine).alias("_t"))
    types = dict(blocks.dtypes)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_id"])
        psi = min(sample, int(pdf["_n"].iloc[0]))
        x = np.stack([np.asarray(v, float) for v in pdf["x"]])
        nodes = _grow(x, pdf["_t"].to_numpy(), trees, int(np.ceil(np.log2(max(psi, 2)))), np.random.default_rng(seed))
        head = pdf.iloc[:1][list(keys)].reset_index(drop=True)
        return head.assign(model=[[float(_c(psi)), *nodes.ravel().tolist()]])

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "model array<double>"])
    # a fixed number of partitions, so that small but costly groups are not packed into few tasks
    width = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = land((s.repartition(width, *keys) if keys else s).groupBy(*keys).applyInPandas(grow, schema))

    def score(m, p):
        nodes = p[1:].reshape(-1, 4)
        where = np.broadcast_to(np.arange(trees), (len(m), trees)).copy()
        row = np.arange(len(m))[:, None]
        while True:
            f = nodes[where, 0].astype(int)
            go = f >= 0
            if not go.any():
                break
            left = m[row, np.maximum(f, 0)] < nodes[where, 1]
            where = np.where(go, np.where(left, nodes[where, 2], nodes[where, 3]).astype(int), where)
        return -(2.0 ** (-nodes[where, 1].mean(1) / max(p[0], 1e-12)))

    return _join(blocks, model, keys).withColumn("iforest_score", _per_block(score)("m", "model")).drop("model")
