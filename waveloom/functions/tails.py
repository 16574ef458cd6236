"""Tail probabilities as Arrow functions (Spark SQL has no erf, incomplete gamma or beta)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, cc = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        cc = b + an / cc or 1e-300
        h *= d * cc
        if abs(d * cc - 1) < 1e-15:
            break
    return scale * h


def _beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, cc, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        cc = 1 + num / cc or 1e-300
        f *= cc * d
        if abs(cc * d - 1) < 1e-15:
            break
    return front * (f - 1)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def f_tail(x: float, d1: float, d2: float) -> float:
    return _beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x >= 0 else 1.0


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of a rank-sum statistic without ties: arrangements in the shorter tail over all arrangements."""
    tail = int(math.floor(min(u, n1 * n2 - u)))  # by symmetry as many lie at or below it as at or above its mirror
    small, large = sorted((n1, n2))
    size = tail + 1
    counts = [np.zeros(size) for _ in range(small + 1)]
    counts[0][0] = 1.0
    for add in range(1, small + large + 1):
        for k in range(min(add, small), 0, -1):
            shift = add - k
            if shift <= large and shift < size:
                counts[k][shift:] += counts[k - 1][:size - shift]
    return float(min(1.0, 2 * counts[small].sum() / math.comb(n1 + n2, n1)))


def _column(fn):
    @F.pandas_udf("double")
    def one(a: pd.Series) -> pd.Series:
        return a.map(lambda v: None if pd.isna(v) else fn(v))

    @F.pandas_udf("double")
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else fn(x, y) for x, y in zip(a, b)])

    @F.pandas_udf("double")
    def three(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) or pd.isna(z) else fn(x, y, z) for x, y, z in zip(a, b, d)])

    return lambda *cols: {1: one, 2: two, 3: three}[len(cols)](*[c.cast("double") for c in cols])


def p_normal(z):
    return _column(normal_two_sided)(z)


def p_chi2(x, df):
    return _column(chi2_tail)(x, df)


def p_f(x, d1, d2):
    return _column(f_tail)(x, d1, d2)


def p_rank_sum(u, n1, n2):
    return _column(lambda a, b, d: rank_sum_exact(a, int(b), int(d)))(u, n1, n2)
