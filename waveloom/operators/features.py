"""Per-window channel features. Input rows are (keys.., channel, x array); nothing here shuffles
except the assembly of feature families."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, a_diff, a_mean, a_moment, a_sum, a_var, c, kurtosis_corrected, let, ratio, skew_corrected
from ..functions.fixed import BANDS
from . import kernels as K


# ---- SIG01, SIG02 -------------------------------------------------------------------------------

def time_stats(windows: DataFrame, x: str = "x", fisher: bool = False) -> DataFrame:
    """SIG01: mean, std, corrected skewness and kurtosis, min, max, ptp, rms, line length, zero-crossing rate."""
    n = F.size(x)
    m2, m3, m4 = F.col("_m2"), F.col("_m3"), F.col("_m4")
    g1 = F.try_divide(m3, F.pow(m2, F.lit(1.5)))
    g2 = F.try_divide(m4, m2 * m2) - 3
    steps = F.greatest(n - 1, F.lit(1))
    signs = F.transform(c(x), lambda v: F.when(v < 0, 1.0).otherwise(0.0))
    moved = windows.withColumn("_m2", a_moment(x, 2)).withColumn("_m3", a_moment(x, 3)).withColumn("_m4", a_moment(x, 4))
    return moved.select(
        *windows.columns,
        a_mean(x).alias("mean"), F.sqrt(m2).alias("std"),
        skew_corrected(n, g1).alias("skew"), kurtosis_corrected(n, g2, fisher).alias("kurtosis"),
        F.array_min(x).alias("min"), F.array_max(x).alias("max"),
        (F.array_max(x) - F.array_min(x)).alias("ptp"),
        F.sqrt(a_sum(F.transform(c(x), lambda v: v * v)) / n).alias("rms"),
        (a_sum(F.transform(a_diff(x), F.abs)) / steps).alias("line_length"),
        (a_sum(F.transform(a_diff(signs), F.abs)) / steps).alias("zero_cross_rate"))


def hjorth(windows: DataFrame, x: str = "x", guard: str = "eps") -> DataFrame:
    """SIG02: activity, mobility, complexity; ``guard`` 'eps' floors the divisors, 'zero' gives 0 instead."""
    w = windows.withColumn("_v0", a_var(x)).withColumn("_d", a_diff(x))
    w = w.withColumn("_v1", a_var("_d")).withColumn("_v2", a_var(a_diff("_d")))
    v0, v1, v2 = F.col("_v0"), F.col("_v1"), F.col("_v2")
    if guard == "eps":
        mob = F.sqrt(v1 / F.greatest(v0, F.lit(EPS)))
        comp = F.sqrt(v2 / F.greatest(v1, F.lit(EPS))) / F.greatest(mob, F.lit(EPS))
    else:
        mob = F.coalesce(F.sqrt(F.try_divide(v1, v0)), F.lit(0.0))
        comp = F.coalesce(F.try_divide(F.sqrt(F.try_divide(v2, v1)), mob), F.lit(0.0))
    return w.select(*windows.columns, v0.alias("hjorth_activity"), mob.alias("hjorth_mobility"), comp.alias("hjorth_complexity"))


# ---- SIG03 - SIG06 ------------------------------------------------------------------------------

def segment_size(n: Column, sfreq: float, rule: str | int) -> Column:
    """Frame length by rule: 'min256' = max(256, 2 fs), 'two_sec' = 2 fs, 'one_sec' = fs, or a number; at most n."""
    want = {"min256": max(256, round(2 * sfreq)), "two_sec": int(2 * sfreq), "one_sec": int(sfreq)}.get(rule, rule)
    return F.least(n, F.lit(int(want)))


def welch_psd(windows: DataFrame, sfreq: float, nperseg: str | int = "min256", x: str = "x") -> DataFrame:
    """SIG03: adds ``psd`` (one-sided density) and ``df`` (bin width in Hz)."""

    @F.pandas_udf("array<double>")
    def psd(xs: pd.Series, size: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(xs), index=xs.index, dtype=object)
        for k, idx in xs.groupby(size).groups.items():
            for i, v in zip(idx, K.by_length(xs.loc[idx], lambda b: K.welch(b, sfreq, int(k)))):
                out.at[i] = v
        return out

    size = segment_size(F.size(x), sfreq, nperseg)
    return windows.withColumn("psd", psd(c(x), size)).withColumn("df", F.lit(float(sfreq)) / size)


def _band(lo: float, hi: float, closed: bool = False) -> Column:
    """Slice of ``psd`` with lo <= f < hi (or <= hi)."""
    first = F.ceil(F.lit(float(lo)) / F.col("df") - 1e-9).cast("int")
    last = (F.floor(F.lit(float(hi)) / F.col("df") + 1e-9) if closed else F.ceil(F.lit(float(hi)) / F.col("df") - 1e-9) - 1).cast("int")
    last = F.least(last, F.size("psd") - 1)
    return F.slice("psd", first + 1, F.greatest(last - first + 1, F.lit(0)))


def _trapezoid(arr: Column) -> Column:
    ends = (F.element_at(arr, 1) + F.element_at(arr, -1)) / 2
    return F.when(F.size(arr) >= 2, (a_sum(arr) - ends) * F.col("df")).otherwise(F.lit(0.0))


def band_power(spectra: DataFrame, bands: Mapping[str, tuple] = BANDS) -> DataFrame:
    """SIG04: adds arrays by band: ``absolute`` (trapezoid over lo <= f < hi), ``relative``, ``log`` (ln(1 + p))."""
    p = spectra.withColumn("absolute", F.array(*[_trapezoid(_band(lo, hi)) for lo, hi in bands.values()]))
    total = F.greatest(a_sum("absolute"), F.lit(EPS))
    return (p.withColumn("relative", let(total, lambda t: F.transform("absolute", lambda v: v / t)))
            .withColumn("log", F.transform("absolute", lambda v: F.log1p(F.greatest(v, F.lit(0.0))))))


def band_sums(spectra: DataFrame, bands: Mapping[str, tuple] = BANDS, eps: float = 1e-12) -> DataFrame:
    """SIG05: closed-band forms: ``mean``, ``share`` of the whole sum, ``log10`` of the sum (-20 if none),
    ``log_share`` = ln((sum + eps) / (sum over the union + eps))."""
    parts = [_band(lo, hi, True) for lo, hi in bands.values()]
    union = _band(min(lo for lo, _ in bands.values()), max(hi for _, hi in bands.values()), True)
    p = spectra.withColumn("_sum", F.array(*[a_sum(b) for b in parts])).withColumn("_union", a_sum(union) + eps)
    p = p.withColumn("mean", F.array(*[ratio(a_sum(b), F.size(b)) for b in parts])).withColumn("_all", a_sum("psd"))
    return (p.withColumn("share", F.transform("_sum", lambda v: ratio(v, F.col("_all"))))
            .withColumn("log10", F.transform("_sum", lambda v: F.when(v > 0, F.log10(v)).otherwise(-20.0)))
            .withColumn("log_share", F.transform("_sum", lambda v: F.ln((v + eps) / F.col("_union"))))
            .drop("_sum", "_union", "_all"))


def entropies(spectra: DataFrame, bands: Mapping[str, tuple] | None = None, bins: int = 32, x: str = "x") -> DataFrame:
    """SIG06: spectral (optionally limited to the span of bands), amplitude histogram and differential entropy."""
    if bands:
        cut = _band(min(lo for lo, _ in bands.values()), max(hi for _, hi in bands.values()))
        use = F.when(F.size(cut) > 0, cut).otherwise(F.col("psd"))
    else:
        use = F.col("psd")
    p = spectra.withColumn("_use", use).withColumn("_tot", F.greatest(a_sum("_use"), F.lit(EPS)))
    # shares need not sum to 1 when the floor applies, so they are divided by their own sum
    q = p.withColumn("_q", F.transform("_use", lambda v: v / F.col("_tot"))).withColumn("_qs", a_sum("_q"))
    plogp = lambda v: F.when(v > 0, -v * F.ln(v)).otherwise(0.0)
    spec = F.when(F.col("_qs") > 0, a_sum(F.transform("_q", lambda v: plogp(v / F.col("_qs"))))).otherwise(0.0)
    spec = spec / F.when(F.size("_q") > 1, F.ln(F.size("_q").cast("double"))).otherwise(1.0)
    lo, hi = F.array_min(x), F.array_max(x)
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    q = q.withColumn("_lo", lo).withColumn("_w", hi - lo)
    q = q.withColumn("_bin", F.transform(c(x), lambda v: F.least(F.floor((v - F.col("_lo")) / F.col("_w") * bins), F.lit(bins - 1))))
    counts = F.transform(F.array_distinct("_bin"), lambda b: F.size(F.filter("_bin", lambda v: v == b)) / F.size("_bin"))
    amp = a_sum(F.transform(counts, plogp)) / max(math.log(bins), EPS)
    diff = 0.5 * F.ln(2 * math.pi * math.e * F.greatest(a_var(x), F.lit(EPS)))
    return q.select(*spectra.columns, spec.alias("entropy_spectral"), amp.alias("entropy_amplitude"), diff.alias("entropy_differential"))


# ---- SIG07, SIG08, SIG09 ------------------------------------------------------------------------

def wavelet_energy(windows: DataFrame, level: int = 5, x: str = "x") -> DataFrame:
    """SIG07: adds ``energy`` = sums of squares for a_level, d_level .. d_1."""

    @F.pandas_udf("array<double>")
    def energy(xs: pd.Series) -> pd.Series:
        return pd.Series(K.by_length(xs, lambda b: K.wavelet_energies(b, level)))

    return windows.withColumn("energy", energy(c(x)))


def higuchi(windows: DataFrame, kmax: int = 8, x: str = "x") -> DataFrame:
    """SIG08: slope of ln L(k) on ln(1/k) for k = 1 .. kmax; null for fewer than 4 samples, NaN where some L(k) is 0."""
    n = F.size(x)

    def length(k):
        def one(m):
            steps = F.floor((n - m - 1) / k).cast("int")
            path = F.aggregate(F.sequence(F.lit(1), steps), F.lit(0.0), lambda s, i: s + F.abs(
                F.element_at(c(x), m + i * k + 1) - F.element_at(c(x), m + (i - 1) * k + 1)))
            return path * ((n - 1) / (steps * k)) / k
        starts = F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda m: m + k <= n - 1)
        return a_mean(F.transform(starts, one))

    pts = F.array(*[F.struct(F.lit(-math.log(k)).alias("u"), length(k).alias("l")) for k in range(1, kmax + 1)])
    w = windows.withColumn("_p", F.filter(pts, lambda p: p["l"].isNotNull()))
    u, v, k = F.col("_p.u"), F.transform("_p", lambda p: F.ln(p["l"])), F.size("_p")
    flat = F.exists("_p", lambda p: p["l"] <= 0)
    dot = lambda a, b: a_sum(F.zip_with(a, b, lambda s, t: s * t))
    slope = F.try_divide(k * dot(u, v) - a_sum(u) * a_sum(v), k * dot(u, u) - a_sum(u) * a_sum(u))
    return w.withColumn("higuchi_fd", F.when((n >= 4) & (k >= 2), F.when(flat, F.lit(float("nan"))).otherwise(slope))).drop("_p")


def derived_ratio(df: DataFrame, numerators: Sequence[str], denominators: Sequence[str], name: str) -> DataFrame:
    """SIG09: first existing numerator column over abs(first existing denominator column) + 1e-8."""
    num = next((k for k in numerators if k in df.columns), None)
    den = next((k for k in denominators if k in df.columns), None)
    if num is None or den is None:
        return df
    return df.withColumn(name, F.col(num) / (F.abs(F.col(den)) + EPS))


# ---- SIG11, SIG14, UDF01 ------------------------------------------------------------------------

FAMILY_ALIASES = {"stats": "time", "statistical": "time", "time_domain": "time", "rbp": "bandpower", "band_power": "bandpower",
                  "relative_band_power": "bandpower", "hfd": "higuchi", "energies": "wavelet", "wavelet_energy": "wavelet"}


def _named(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in cols])


def _family_time(w, sfreq, bands):
    d = time_stats(w)
    return d, _named(d, ["mean", "std", "skew", "kurtosis", "min", "max", "ptp", "rms", "line_length", "zero_cross_rate"])


def _family_hjorth(w, sfreq, bands):
    d = hjorth(w)
    return d, _named(d, ["hjorth_activity", "hjorth_mobility", "hjorth_complexity"])


def _family_bandpower(w, sfreq, bands):
    d = band_power(welch_psd(w, sfreq), bands)
    names = F.array(*[F.lit(f"rbp_{b}") for b in bands])
    return d, F.zip_with(names, "relative", lambda n, v: F.struct(n.alias("feature"), v.alias("value")))


def _family_entropy(w, sfreq, bands):
    d = entropies(welch_psd(w, sfreq))
    return d, _named(d, ["entropy_spectral", "entropy_amplitude", "entropy_differential"])


def _family_higuchi(w, sfreq, bands):
    d = higuchi(w)
    return d, _named(d, ["higuchi_fd"])


def _family_wavelet(w, sfreq, bands):
    d = wavelet_energy(w)
    names = F.array(*[F.lit(n) for n in ["a5", "d5", "d4", "d3", "d2", "d1"]])
    return d, F.zip_with(names, "energy", lambda n, v: F.struct(n.alias("feature"), v.alias("value")))


FAMILIES = {"time": _family_time, "hjorth": _family_hjorth, "bandpower": _family_bandpower,
            "entropy": _family_entropy, "higuchi": _family_higuchi, "wavelet": _family_wavelet}


def register_family(name: str, fn) -> None:
    """UDF01: add a feature family ``fn(windows, sfreq, bands) -> (DataFrame, array<struct(feature, value)>)``."""
    FAMILIES[name] = fn


def resolve_families(names: Sequence[str]) -> list[str]:
    """Aliases resolved and repeats dropped in request order; an unknown name raises."""
    out: list[str] = []
    for n in names:
        key = FAMILY_ALIASES.get(n, n)
        if key not in FAMILIES:
            raise ValueError(f"unknown feature family {n!r}; known: {sorted(FAMILIES)}")
        if key not in out:
            out.append(key)
    return out


def feature_set(windows: DataFrame, families: Sequence[str], sfreq: float, bands: Mapping[str, tuple] = BANDS,
                x: str = "x") -> DataFrame:
    """SIG11: long features (keys.., channel, family, feature, ord, value) of the listed families in request order.

    All families are computed on the same row, so windows are read once and not joined.
    """
    base = [k for k in windows.columns if k != x]
    cur, cells = windows, []
    for i, fam in enumerate(resolve_families(families)):
        d, named = FAMILIES[fam](cur, sfreq, bands)
        cell = f"_fam_{i}"
        tag = F.lit(fam)
        cur = d.withColumn(cell, F.transform(named, lambda s: F.struct(tag.alias("family"), s["feature"].alias("feature"), s["value"].alias("value"))))
        cells.append(cell)
        cur = cur.select(*base, x, *cells)
    return (cur.select(*base, F.posexplode_outer(F.concat(*cells)).alias("ord", "f"))
            .select(*base, F.col("f.family").alias("family"), F.col("f.feature").alias("feature"), "ord", F.col("f.value").alias("value")))


def expanded_names(families: Sequence[str], bands: Sequence[str]) -> list[tuple[str, str]]:
    """PRJ16: (family, feature) in order; a family without sub-features stands for itself."""
    per = {"rbp": [f"rbp_{b}" for b in bands], "hjorth": [f"hjorth_{n}" for n in ("activity", "mobility", "complexity")],
           "energies": [f"energy_{n}" for n in ("d1", "d2", "d3", "d4", "d5", "a5")]}
    return [(f, n) for f in families for n in per.get(f, [f])]
