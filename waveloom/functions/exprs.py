"""Small Column -> Column helpers used across operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 1e-8


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that a lambda over array elements does not evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def random_hex(*parts) -> Column:
    """Portable pseudo-random key: the same text in every engine, free of partitioning."""
    return F.md5(F.concat_ws("|", *[c(p).cast("string") for p in parts]))


def random_unit(*parts) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits of the key."""
    return F.conv(F.substring(random_hex(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def random_below(n, *parts) -> Column:
    """Uniform integer in [0, n) from the key."""
    return F.floor(random_unit(*parts) * c(n)).cast("long")


def ratio(a, b, default=0.0) -> Column:
    """a / b, ``default`` where b is zero or null."""
    return F.coalesce(F.try_divide(c(a), c(b)), F.lit(default))


# ---- arrays -------------------------------------------------------------------------------------

def a_sum(x) -> Column:
    return F.aggregate(c(x), F.lit(0.0), lambda s, v: s + v)


def a_mean(x) -> Column:
    return F.try_divide(a_sum(x), F.size(c(x)))


def a_center(x) -> Column:
    return let(a_mean(x), lambda m: F.transform(c(x), lambda v: v - m))


def a_dot(a, b) -> Column:
    return a_sum(F.zip_with(c(a), c(b), lambda u, v: u * v))


def a_moment(x, p: int) -> Column:
    """Central population moment of order ``p``."""
    return let(a_mean(x), lambda m: a_sum(F.transform(c(x), lambda v: F.pow(v - m, F.lit(p))))) / F.size(c(x))


def a_var(x) -> Column:
    return let(a_mean(x), lambda m: a_sum(F.transform(c(x), lambda v: (v - m) * (v - m)))) / F.size(c(x))


def a_diff(x) -> Column:
    n = F.size(c(x))
    return F.zip_with(F.slice(c(x), 2, n - 1), F.slice(c(x), 1, n - 1), lambda u, v: u - v)


def a_unit(x) -> Column:
    """x / |x|, zeros where the norm vanishes."""
    return let(F.sqrt(a_dot(x, x)), lambda n: F.transform(c(x), lambda v: F.when(n > 1e-12, v / n).otherwise(0.0)))


def argmax_first(arr) -> Column:
    """0-based position of the largest element, the first one on ties."""
    return (F.array_position(c(arr), F.array_max(c(arr))) - 1).cast("long")


def softmax(arr) -> Column:
    e = let(F.array_max(c(arr)), lambda m: F.transform(c(arr), lambda v: F.exp(v - m)))
    return share(e)


def share(arr, floor: float = 0.0) -> Column:
    """Elements divided by their sum (kept at or above ``floor``)."""
    return let(F.greatest(a_sum(arr), F.lit(floor)), lambda s: F.transform(c(arr), lambda v: v / s))


# ---- corrected moments --------------------------------------------------------------------------

def skew_corrected(n, g1) -> Column:
    """Bias-corrected skewness from the population form (as it is for n <= 2); 0 where undefined."""
    n = c(n).cast("double")
    return F.coalesce(F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * c(g1)).otherwise(c(g1)), F.lit(0.0))


def kurtosis_corrected(n, g2, fisher: bool = False) -> Column:
    """Bias-corrected kurtosis from the population excess (as it is for n <= 3); Pearson form unless ``fisher``;
    0 where undefined."""
    n = c(n).cast("double")
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * c(g2) + 6)
    return F.coalesce(F.when(n > 3, corrected).otherwise(c(g2)) + (0.0 if fisher else 3.0), F.lit(0.0))


# ---- windows ------------------------------------------------------------------------------------

def over(keys: Sequence[str], *order):
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def pick_first(df, keys: Sequence[str], *order, k: int = 1, rank: str | None = None):
    """The first ``k`` rows per key; the rank filter is pushed before the shuffle by Spark."""
    out = df.withColumn("_rk", F.row_number().over(over(keys, *order))).filter(F.col("_rk") <= k)
    return out.withColumnRenamed("_rk", rank) if rank else out.drop("_rk")


def zscore(x, window, ddof: int = 0, eps: float = EPS, guard: str = "one") -> Column:
    """z-score over a window; ``guard`` 'one': a std below eps becomes 1; 'add': divide by std + eps;
    'clamp': std at least eps."""
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(c(x)).over(window)
    sd = F.coalesce(sd, F.lit(0.0))
    den = {"one": F.when(sd < eps, 1.0).otherwise(sd), "add": sd + eps, "clamp": F.greatest(sd, F.lit(eps))}[guard]
    return (c(x) - F.avg(c(x)).over(window)) / den


def fixed_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
