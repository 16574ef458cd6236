"""Whitening of embeddings: distributed covariance, own symmetric eigensolver, broadcast projection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

_EPS = np.finfo(float).eps


# ---------------------------------------------------------------- leading eigenpairs of a symmetric matrix

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors of Q'VQ, by Householder reflections from the first column on.

    Row k of the reflectors is the unit vector u of the k-th reflection 1 - 2uu' (zero where none is needed).
    """
    a, d = v.astype(float).copy(), len(v)
    u = np.zeros((max(d - 2, 0), d))
    for k in range(d - 2):
        x = a[k + 1:, k]
        scale = np.abs(x).max()
        tail = np.sqrt(((x[1:] / scale) ** 2).sum()) * scale if scale else 0.0
        if tail == 0.0:
            continue
        w = x / scale
        w[0] += math.copysign(np.linalg.norm(w), w[0])
        w /= np.linalg.norm(w)
        u[k, k + 1:] = w
        # two-sided: A - 2wq' - 2qw' with q = Aw - (w'Aw) w
        b = a[k + 1:, k + 1:]
        p = b @ w
        q = p - (w @ p) * w
        b -= 2 * (np.outer(w, q) + np.outer(q, w))
        a[k + 1:, k] -= 2 * w * (w @ x)
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), u


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix lie below each point (negative pivots of T - point)."""
    least = np.finfo(float).tiny * max(1.0, float(np.abs(off).max(initial=0.0)) ** 2)
    pivot, n = np.ones(len(points)), np.zeros(len(points), int)
    for k in range(len(diagonal)):
        pivot = diagonal[k] - points - (off[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        n += pivot < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, largest first; all are bisected together, to rounding of each (of the matrix, for tiny ones)."""
    d = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])  # Gershgorin
    lo, hi = (np.full(count, x) for x in ((diagonal - reach).min(), (diagonal + reach).max()))
    size = max(abs(lo[0]), abs(hi[0]), 1e-300)
    lo, hi = lo - 4 * _EPS * size, hi + 4 * _EPS * size
    rank = d - np.arange(count)  # the k-th largest has fewer than d - k eigenvalues below it
    while True:
        mid = lo + (hi - lo) / 2
        if (hi - lo <= 2 * _EPS * np.maximum(np.abs(mid), 1e-4 * size)).all():
            return mid
        over = below(diagonal, off, mid) >= rank
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)


def _solve(diagonal, off, shift, right):
    """(T - shift) x = right by elimination with row exchanges; a vanishing pivot is replaced by a tiny one."""
    n = len(diagonal)
    size = max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), 1e-300)
    tiny = _EPS * size
    main, up, up2, x = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()
    for k in range(n - 1):
        low = off[k]
        if abs(low) > abs(main[k]):  # exchange rows k and k + 1
            f = main[k] / low
            main[k], up[k], up2[k], main[k + 1], up[k + 1] = low, main[k + 1], up[k + 1], up[k] - f * main[k + 1], -f * up[k + 1]
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            if abs(main[k]) < tiny:
                main[k] = tiny
            f = low / main[k]
            main[k + 1] -= f * up[k]
            x[k + 1] -= f * x[k]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for k in range(n - 1, -1, -1):
        s = x[k]
        if k + 1 < n:
            s -= up[k] * x[k + 1]
        if k + 2 < n:
            s -= up2[k] * x[k + 2]
        x[k] = s / main[k]
        if abs(x[k]) > 1e100:
            x /= abs(x[k])
    return x


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Vectors come from inverse iteration on the tridiagonal matrix. Eigenvalues closer than a thousandth of the
    matrix's size form a cluster; within it each vector is made orthogonal to the earlier ones in every
    step, and shifts of equal values are drawn apart by a few rounding errors.
    """
    d = len(v)
    count = min(count, d)
    diagonal, off, reflectors = tridiagonal(v)
    values = leading_values(diagonal, off, count)
    size = max(float(np.abs(diagonal).max()) + 2 * float(np.abs(off).max(initial=0.0)), 1e-300)
    rng = np.random.default_rng(7)
    x = np.zeros((d, count))
    first, shift = 0, None
    for k in range(count):
        if k and values[k - 1] - values[k] > 1e-3 * size:
            first, shift = k, None
        shift = values[k] if shift is None else min(values[k], shift - 10 * _EPS * size)
        y = rng.standard_normal(d)
        near = x[:, first:k]
        for _ in range(8):
            y = _solve(diagonal, off, shift, y / np.linalg.norm(y))
            y /= np.abs(y).max()
            for _ in range(2):
                y -= near @ (near.T @ y)
            y /= np.linalg.norm(y)
            r = diagonal * y - values[k] * y
            r[:-1] += off * y[1:]
            r[1:] += off * y[:-1]
            if np.abs(r).max() <= 8 * _EPS * size:
                break
        x[:, k] = y
    for k in range(len(reflectors) - 1, -1, -1):
        w = reflectors[k]
        x -= 2 * np.outer(w, w @ x)
    return values, x


# ---------------------------------------------------------------- over the table

def entries(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, x: 64 times each entry, rounded down, plus 1,000,000; rows without a vector or with a null or non-finite entry are left out."""
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fits = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**46)))
    x = F.transform("v", lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long"))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(fits).select("id", x.alias("x"))


def _rows(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit numbers, or Python's where those could overflow."""
    if sums.dtype == object or (x.size and float(np.abs(x).max()) * n >= 2.0**62):
        return x.astype(object) * n - sums
    return x.astype(np.int64) * n - sums


def _summed(df: DataFrame, one_array) -> np.ndarray:
    """Sum of an array that each task makes from its rows; position by position in Spark, so no task and not the driver sees all parts."""
    def part(batches):
        out = None
        for b in batches:
            if b.num_rows:
                a = one_array(b)
                out = a if out is None else out + a
        if out is not None:
            yield pa.RecordBatch.from_pydict({"a": pa.array([out], pa.list_(pa.float64()))})

    got = df.mapInArrow(part, "a array<double>").select(F.posexplode("a").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # one row per entry
    out = np.zeros(got.num_rows)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


class Whitener:
    """n, exact sums S, covariance, components and their eigenvalues of the fit list."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int):
        self.n, self.sums, self.dim = n, sums, len(sums)
        self.trace = float(np.trace(covariance))
        values, vectors = leading(covariance, components) if self.trace > 0 else (np.zeros(0), np.zeros((self.dim, 0)))
        # directions without spread cannot be scaled to spread 1
        self.kept = int((values > self.trace * self.dim * _EPS * 16).sum())
        self.values, self.vectors = values[: self.kept], vectors[:, : self.kept]

    def project(self, x: np.ndarray) -> np.ndarray:
        return (_offsets(x, self.n, self.sums) / self.n).astype(float) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; None beyond 64 bits."""
        o = _offsets(x, self.n, self.sums)
        if o.dtype != object and len(o) and float(np.abs(o).max()) ** 2 * self.dim < 2.0**62:
            return (o * o).sum(1).tolist()
        exact = [sum(v * v for v in row) for row in o.tolist()]
        return [s if s < 2**63 else None for s in exact]


def whiten(df: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: one row per usable row and component.

    Each entry c becomes x = floor(64 c) + 1,000,000. The fit list is each distinct x vector once: n of them with sums S; its
    covariance V (divisor n, centred before multiplying) has unit eigenvectors, numbered from 1 by falling eigenvalue e.
    deviation: sum of (n x - S)^2, exact (null where 64 bits cannot hold it). whitened: x - S/n on the component, over
    sqrt(e). explained: e / trace(V). identity_error: largest entry of the covariance of whitened over the fit
    list minus the identity.

    Vectors that are null or empty, or hold null, non-finite or huge entries (2^46 and beyond), take no part; nor do those of
    another length than the most frequent one (the smaller of equally frequent ones). Components without spread are left
    out: one distinct vector gives no rows, and d + 1 distinct vectors at most d components. Repeated rows and rows
    with a null id count once in the fit and give rows each. An empty table gives no rows. Other columns are not read.

    Sums and covariance are partial arrays per task (d and d (d + 1) / 2 numbers), added by position. The driver gets
    one summed array and solves a matrix of d x d; tasks get the components.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    base = entries(df, id_col, vec_col)
    length = base.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    dim = length["d"]
    base = base.filter(F.size("x") == dim)
    fit, _ = Scratch(spark).land(base.select("x").distinct())
    n = fit.count()
    # sums of 64-bit numbers in two halves, each exact as a double up to 2^53
    low = _summed(fit, lambda b: (_rows(b.column(0), dim) & 0xFFFFF).sum(0).astype(float))
    high = _summed(fit, lambda b: (_rows(b.column(0), dim) >> 20).sum(0).astype(float))
    exact = [int(h) * (1 << 20) + int(w) for h, w in zip(high.tolist(), low.tolist(), strict=True)]
    sums = np.array(exact, np.int64 if max(map(abs, exact)) < 2**62 else object)
    upper = np.triu_indices(dim)

    def products(b):
        c = (_offsets(_rows(b.column(0), dim), n, sums) / n).astype(float)
        return (c.T @ c)[upper]

    covariance = np.zeros((dim, dim))
    covariance[upper] = _summed(fit, products) / n
    covariance = covariance + np.triu(covariance, 1).T
    model = Whitener(n, sums, covariance, components)
    k = model.kept
    if not k:
        return spark.createDataFrame([], schema)
    box = spark.sparkContext.broadcast(model)  # dim x components numbers

    def spread(b):
        w = box.value.project(_rows(b.column(0), dim))
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    total = _summed(fit, spread) / n  # centred already: the mean is rounding error
    error = float(np.abs(total[k:].reshape(k, k) - np.outer(total[:k], total[:k]) - np.eye(k)).max())
    explained = model.values / model.trace

    def project(batches):
        m = box.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x = _rows(part.column(1), dim)
                rows = np.repeat(np.arange(len(x)), k)
                one = np.ones(len(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array((one * m.n).astype(np.int64)),
                    pa.array(m.deviation(x), pa.int64()).take(pa.array(rows)), pa.array(m.project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(one * error)],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return base.select(F.col("id").alias(id_col), "x").mapInArrow(project, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
