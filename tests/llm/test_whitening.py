"""Whitening against exact integers and numpy's own eigensolver."""

from collections import Counter

import numpy as np
import pytest

from waveloom.llm import whitening


def close(values, vectors, v, tol=1e-12):
    want = np.sort(np.linalg.eigvalsh(v))[::-1][: len(values)]
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(values - want).max() <= tol * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * values).max() <= 10 * tol * size


def test_eigenpairs():
    rng = np.random.default_rng(2)
    for d, count in ((1, 1), (2, 2), (3, 3), (5, 5), (20, 16), (64, 16), (150, 16)):
        m = rng.standard_normal((d, 2 * d))
        v = m @ m.T / (2 * d)
        close(*whitening.leading(v, count), v)
        close(*whitening.leading(v * 1e-20, count), v * 1e-20)
        close(*whitening.leading(np.diag(np.diag(v)), count), np.diag(np.diag(v)))  # no off-diagonal at all
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for spectrum in (np.ones(40), np.repeat([5.0, 3.0, 1.0, 0.0], 10), np.r_[1 + 1e-14 * np.arange(20), np.full(20, 0.5)], np.r_[np.full(3, 2.0), np.zeros(37)], 10.0 ** -np.arange(40)):
        v = q @ np.diag(spectrum) @ q.T
        v = (v + v.T) / 2
        close(*whitening.leading(v, 16), v)
    w = np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)  # pairs of nearly equal values
    close(*whitening.leading(w, 16), w)


def test_sturm_counts():
    rng = np.random.default_rng(3)
    diagonal, off = rng.standard_normal(30), rng.standard_normal(29)
    off[[4, 11]] = 0
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    points = np.concatenate([values - 1e-9, values + 1e-9, [-99, 99]])
    assert whitening.below(diagonal, off, points).tolist() == [(values < p).sum() for p in points]


def brute(rows, components):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 2.0**46 for c in v)]
    lengths = Counter(len(v) for _, v in good)
    dim = min(lengths, key=lambda d: (-lengths[d], d))
    good = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in good if len(v) == dim]
    fit = sorted({x for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(n * c - t) for c, t in zip(x, s)] for x in fit]) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, x in good:
        o = [n * c - t for c, t in zip(x, s)]
        out.setdefault(i, []).append((n, sum(c * c for c in o), np.array(o, float) / n @ u[:, :components] / np.sqrt(np.maximum(e[:components], 1e-30)), e[:components] / v.trace()))
    return out


@pytest.mark.parametrize(("dim", "rows"), [(8, 300), (40, 900), (3, 4)])
def test_whitening_equals_brute_force(spark, dim, rows):
    rng = np.random.default_rng(dim)
    mix = rng.standard_normal((dim, dim)) * np.linspace(3, 0.5, dim)
    data = [(k, [float(np.float32(c)) for c in rng.standard_normal(dim) @ mix]) for k in range(rows)]
    data += [(1000 + k, data[1][1]) for k in range(rows // 2)]  # one vector holds a third of all rows
    data += [(2000, None), (2001, []), (2002, [None] * dim), (2003, [float("nan")] * dim), (2004, [float("inf")] * dim), (2005, [1.0] * (dim + 1)), (2006, [1e300] * dim), (None, data[2][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, n int, component int").repartition(4)
    got = {}
    for r in whitening.whiten(df).collect():
        got.setdefault(r["vec_id"], []).append(r)
    want = brute(data, min(16, dim))
    k = min(16, dim)
    assert got.keys() == want.keys()
    signs = None
    for i, w in want.items():
        rows_of = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in rows_of] == list(range(1, k + 1)) and len(w) == 1
        assert all(r["n"] == w[0][0] and r["deviation"] == w[0][1] and r["identity_error"] < 1e-9 for r in rows_of)
        x = np.array([r["whitened"] for r in rows_of])
        signs = np.sign(x * w[0][2]) if signs is None else signs
        assert np.abs(x * signs - w[0][2]).max() < 1e-8
        assert np.allclose([r["explained"] for r in rows_of], w[0][3], rtol=1e-9)


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k % 3)]) for k in range(9)], schema)  # one direction only
    got = whitening.whiten(flat).collect()
    assert len(got) == 9 and {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(2**40 + k * 2**20), float(-(2**45) + k)]) for k in range(40)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    exact = [sum((40 * c - t) ** 2 for c, t in zip(v, s)) for v in x]
    assert got == {k: e if e < 2**63 else None for k, e in enumerate(exact)} and None in got.values()
