"""Channel-to-channel measures of windows and reductions over them.

Input windows are rows (keys.., channel, x). Pair rows are produced by gathering the few channels of
one window once and expanding i < j, so there is a single shuffle on the window key. Edges are rows
(keys.., metric, band, i, j, value) with i < j.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, a_center, a_dot, a_unit, c, over
from ..functions.fixed import BANDS
from . import kernels as K

WKEYS = ("subject_id", "segment_id")


# ---- pairs --------------------------------------------------------------------------------------

def channel_pairs(windows: DataFrame, cols: Sequence[str], keys: Sequence[str] = WKEYS) -> DataFrame:
    """(keys.., i, j, a_<col>, b_<col>) for channels i < j of a window."""
    g = windows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel", *cols))).alias("_c"))
    g = g.select(*keys, "_c", F.posexplode("_c").alias("_p", "_a"))
    g = g.select(*keys, "_a", F.explode(F.slice("_c", F.col("_p") + 2, F.size("_c"))).alias("_b"))
    return g.select(*keys, F.col("_a.channel").alias("i"), F.col("_b.channel").alias("j"),
                    *[F.col(f"_a.{k}").alias(f"a_{k}") for k in cols], *[F.col(f"_b.{k}").alias(f"b_{k}") for k in cols])


def _edges(df: DataFrame, keys, metric: str, value: Column, band: Column | None = None) -> DataFrame:
    b = F.lit(None).cast("string") if band is None else band
    return df.select(*keys, F.lit(metric).alias("metric"), b.alias("band"), "i", "j", value.alias("value"))


def pearson(windows: DataFrame, keys: Sequence[str] = WKEYS, x: str = "x", metric: str = "pearson") -> DataFrame:
    """CON01: correlation, 0 where a channel is constant. Channels are centred and scaled once, pairs are dot products."""
    p = channel_pairs(windows.withColumn("u", a_unit(a_center(x))), ["u"], keys)
    return _edges(p, keys, metric, a_dot("a_u", "b_u"))


def spearman(windows: DataFrame, keys: Sequence[str] = WKEYS, x: str = "x") -> DataFrame:
    """CON02: correlation of average ranks."""

    @F.pandas_udf("array<double>")
    def ranks(xs: pd.Series) -> pd.Series:
        return pd.Series(K.by_length(xs, lambda m: pd.DataFrame(m).rank(axis=1).to_numpy()))

    return pearson(windows.withColumn(x, ranks(c(x))), keys, x, "spearman")


def _matrix_kernel(windows: DataFrame, keys: Sequence[str], x: str, fn, names: Sequence[str], metric: str, banded: bool) -> DataFrame:
    """Edges from ``fn([channels, n]) -> [bands, channels, channels]`` run on whole windows in Arrow batches.

    Kernel results are unpacked with the outer form: the inner one makes Spark filter on the result first, which would run the
    kernel twice.
    """

    @F.pandas_udf("array<array<double>>")
    def run(ms: pd.Series) -> pd.Series:
        out = []
        for m in ms:
            v = fn(K.matrix(m))
            iu = np.triu_indices(v.shape[-1], 1)
            out.append([row[iu].tolist() for row in v])
        return pd.Series(out)

    g = windows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel", c(x).alias("x")))).alias("_c"))
    ch = F.col("_c.channel")
    pos = F.sequence(F.lit(1), F.size("_c"))
    pair = F.flatten(F.transform(pos, lambda i: F.transform(
        F.slice(pos, i + 1, F.size(pos)), lambda j: F.struct(F.element_at(ch, i).alias("i"), F.element_at(ch, j).alias("j")))))
    g = g.filter(F.size("_c") > 1).select(*keys, run(F.col("_c.x")).alias("_v"), pair.alias("_ij"))
    b = g.select(*keys, "_ij", F.posexplode_outer("_v").alias("_b", "_w"))
    e = b.select(*keys, "_b", F.explode(F.arrays_zip("_ij", "_w")).alias("e"))
    band = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_b") + 1) if banded else None
    return _edges(e.select(*keys, "_b", F.col("e._ij.i").alias("i"), F.col("e._ij.j").alias("j"), F.col("e._w").alias("_w")),
                  keys, metric, F.col("_w"), band)


def coherence(windows: DataFrame, sfreq: float, bands: Mapping[str, tuple] = BANDS, nperseg: int | None = None,
              closed: bool = False, keys: Sequence[str] = WKEYS, x: str = "x") -> DataFrame:
    """CON03: mean magnitude-squared coherence over lo <= f < hi (<= hi if ``closed``), 0 if no bin falls in."""

    def fn(m):
        size = min(m.shape[1], nperseg or max(256, round(2 * sfreq)))
        coh = K.coherence(m, size)
        f = np.fft.rfftfreq(size, 1 / sfreq)
        out = []
        for lo, hi in bands.values():
            mask = (f >= lo) & ((f <= hi) if closed else (f < hi))
            out.append(coh[:, :, mask].mean(axis=2) if mask.any() else np.zeros(coh.shape[:2]))
        return np.stack(out)

    return _matrix_kernel(windows, keys, x, fn, list(bands), "coherence", True)


def _phases(m: np.ndarray, sfreq: float, band: tuple | None) -> np.ndarray:
    if band is not None:
        m = K.zero_phase(K.butter_sos(4, sfreq, *band), m)
    return np.angle(K.analytic(m))


_PHASE = {
    "pli": lambda d: np.abs(np.mean(np.sign(np.sin(d)), axis=-1)),
    "wpli": lambda d: np.abs(np.mean(np.sin(d), axis=-1)) / np.maximum(np.mean(np.abs(np.sin(d)), axis=-1), EPS),
    "plv": lambda d: np.abs(np.mean(np.exp(1j * d), axis=-1)),
    "phase_lag": lambda d: np.mean(np.abs(np.angle(np.exp(1j * d))), axis=-1),
}


def phase_measure(windows: DataFrame, sfreq: float, metric: str, bands: Mapping[str, tuple | None] = BANDS,
                  keys: Sequence[str] = WKEYS, x: str = "x") -> DataFrame:
    """CON04 'pli', 'wpli' (phase form), 'plv' and CON05 'phase_lag': per band, phases once per channel, then pairs.

    A band of None takes the phase of the unfiltered signal.
    """
    f = _PHASE[metric]

    def fn(m):
        out = []
        for band in bands.values():
            p = _phases(m, sfreq, band)
            out.append(f(p[:, None, :] - p[None, :, :]))
        return np.stack(out)

    return _matrix_kernel(windows, keys, x, fn, list(bands), metric, True)


def envelope_correlation(windows: DataFrame, sfreq: float, bands: Mapping[str, tuple], keys: Sequence[str] = WKEYS, x: str = "x") -> DataFrame:
    """CON06: correlation of amplitude envelopes per band."""

    def fn(m):
        out = []
        for band in bands.values():
            y = K.zero_phase(K.butter_sos(4, sfreq, *band), m) if band is not None else m
            e = np.abs(K.analytic(y))
            e = e - e.mean(axis=1, keepdims=True)
            n = np.sqrt((e**2).sum(axis=1))
            n[n == 0] = np.inf
            out.append(e @ e.T / np.outer(n, n))
        return np.stack(out)

    return _matrix_kernel(windows, keys, x, fn, list(bands), "aec", True)


def mutual_information(windows: DataFrame, bins: int = 16, keys: Sequence[str] = WKEYS, x: str = "x") -> DataFrame:
    """CON07: mutual information in nats from a bins x bins joint histogram."""

    def fn(m):
        lo, hi = m.min(axis=1, keepdims=True), m.max(axis=1, keepdims=True)
        flat = hi == lo
        lo, hi = np.where(flat, lo - 0.5, lo), np.where(flat, hi + 0.5, hi)
        b = np.minimum(np.floor((m - lo) / (hi - lo) * bins).astype(int), bins - 1)
        one = (b[:, None, :] == np.arange(bins)[None, :, None]).astype(float)
        n = m.shape[1]
        joint = np.einsum("apt,bqt->abpq", one, one, optimize=True) / n
        marg = one.sum(axis=2) / n
        prod = marg[:, None, :, None] * marg[None, :, None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(joint > 0, joint * np.log(joint / prod), 0.0)
        return t.sum(axis=(2, 3))[None]

    return _matrix_kernel(windows, keys, x, fn, ["all"], "mutual_info", False)


def wavelet_coherence(windows: DataFrame, sfreq: float, band: tuple | None = None, method: str = "average",
                      keys: Sequence[str] = WKEYS, x: str = "x") -> DataFrame:
    """CON08: Morlet wavelet coherence, reduced by average, max or median over frequency, or 'time-average'."""
    reduce = {"average": np.mean, "max": np.max, "median": np.median}

    def fn(m):
        w, f = K.morlet_cwt(m, 1 / sfreq)
        use = np.ones(len(f), bool) if band is None else (f >= band[0]) & (f <= band[1])
        n = len(m)
        out = np.zeros((n, n))
        if not use.any():
            return out[None]
        w = w[:, use]
        power = np.abs((w * w.conj()).mean(axis=2))
        for i in range(n):
            for j in range(i + 1, n):
                cross = w[i] * w[j].conj()
                with np.errstate(divide="ignore", invalid="ignore"):
                    if method == "time-average":
                        v = np.mean(np.nan_to_num(np.abs(cross) / (np.abs(w[i]) * np.abs(w[j]))))
                    else:
                        v = reduce[method](np.nan_to_num(np.abs(cross.mean(axis=1)) / np.sqrt(power[i] * power[j])))
                out[i, j] = out[j, i] = v
        return out[None]

    return _matrix_kernel(windows, keys, x, fn, ["all"], "wavelet_coherence", False)


# ---- CON09 --------------------------------------------------------------------------------------

METRICS = {
    "pearson": lambda w, fs, b, k: pearson(w, k),
    "spearman": lambda w, fs, b, k: spearman(w, k),
    "coherence": lambda w, fs, b, k: coherence(w, fs, b, keys=k),
    "pli": lambda w, fs, b, k: phase_measure(w, fs, "pli", b, k),
    "wpli": lambda w, fs, b, k: phase_measure(w, fs, "wpli", b, k),
    "plv": lambda w, fs, b, k: phase_measure(w, fs, "plv", b, k),
    "aec": lambda w, fs, b, k: envelope_correlation(w, fs, b, k),
    "mutual_info": lambda w, fs, b, k: mutual_information(w, keys=k),
    "wavelet_coherence": lambda w, fs, b, k: wavelet_coherence(w, fs, keys=k),
}
METRIC_ALIASES = {"corr": "pearson", "correlation": "pearson", "coh": "coherence", "mi": "mutual_info", "wcoh": "wavelet_coherence"}


def register_metric(name: str, fn) -> None:
    """UDF01: add a connectivity metric ``fn(windows, sfreq, bands, keys) -> edges``."""
    METRICS[name] = fn


def compute_metrics(windows: DataFrame, metrics: Sequence[str], sfreq: float, bands: Mapping[str, tuple] = BANDS,
                    keys: Sequence[str] = WKEYS, stack_bands: bool = False) -> DataFrame:
    """CON09: union of the requested metrics; with ``stack_bands`` a metric without bands is repeated for every band."""
    out = None
    for name in dict.fromkeys(METRIC_ALIASES.get(m, m) for m in metrics):
        if name not in METRICS:
            raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
        e = METRICS[name](windows, sfreq, bands, list(keys))
        if stack_bands:
            every = F.array(*[F.lit(b) for b in bands])
            e = e.withColumn("band", F.explode(F.when(F.col("band").isNull(), every).otherwise(F.array("band"))))
        out = e if out is None else out.unionByName(e)
    return out


# ---- matrices as rows ---------------------------------------------------------------------------

def mirror(edges: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Both directions of every edge, produced in one pass."""
    rest = [k for k in edges.columns if k not in (i, j)]
    both = F.array(F.struct(F.col(i).alias("i"), F.col(j).alias("j")), F.struct(F.col(j).alias("i"), F.col(i).alias("j")))
    return edges.select(*rest, F.explode(both).alias("_e")).select(*rest, F.col("_e.i").alias(i), F.col("_e.j").alias(j)).select(*edges.columns)


def postprocess(entries: DataFrame, graph: Sequence[str], *, value: str = "value", symmetrize: bool = True, zero_diagonal: bool = True,
                threshold: float | None = None, threshold_mode: str = "abs", normalize: str = "none",
                clip: tuple | None = None) -> DataFrame:
    """CON10: full matrices as rows (graph.., i, j, value): NaN to 0, symmetrize, zero diagonal, threshold, normalize, clip.

    (i, j) and (j, i) meet by grouping on the unordered pair; a matrix is bounded by its channel count.
    """
    v = F.coalesce(F.nanvl(F.col(value), F.lit(0.0)), F.lit(0.0))
    v = F.when(F.abs(v) == float("inf"), 0.0).otherwise(v)
    m = entries.withColumn("v", v)
    if symmetrize:
        m = m.groupBy(*graph, F.least("i", "j").alias("_p"), F.greatest("i", "j").alias("_q")).agg(
            F.coalesce(F.max(F.when(F.col("i") <= F.col("j"), F.col("v"))), F.lit(0.0)).alias("_up"),
            F.coalesce(F.max(F.when(F.col("i") >= F.col("j"), F.col("v"))), F.lit(0.0)).alias("_lo"))
        m = m.withColumn("v", (F.col("_up") + F.col("_lo")) / 2)
        ends = F.when(F.col("_p") == F.col("_q"), F.array(F.struct(F.col("_p").alias("i"), F.col("_q").alias("j")))).otherwise(
            F.array(F.struct(F.col("_p").alias("i"), F.col("_q").alias("j")), F.struct(F.col("_q").alias("i"), F.col("_p").alias("j"))))
        m = m.select(*graph, F.explode(ends).alias("e"), "v").select(*graph, "e.i", "e.j", "v")
    if zero_diagonal:
        m = m.withColumn("v", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.col("v")))
    if threshold is not None:
        keep = {"abs": F.abs("v") >= threshold, "positive": F.col("v") >= threshold, "negative": F.col("v") <= -threshold}[threshold_mode]
        m = m.withColumn("v", F.when(keep, F.col("v")).otherwise(0.0))
    w = over(list(graph))
    if normalize == "minmax":
        lo, span = F.min("v").over(w), F.max("v").over(w) - F.min("v").over(w)
        m = m.withColumn("v", F.when(span < EPS, 0.0).otherwise((F.col("v") - lo) / span))
    elif normalize == "zscore":
        sd = F.stddev_pop("v").over(w)
        m = m.withColumn("v", F.when(sd < EPS, 0.0).otherwise((F.col("v") - F.avg("v").over(w)) / sd))
    if clip:
        m = m.withColumn("v", F.least(F.greatest("v", F.lit(float(clip[0]))), F.lit(float(clip[1]))))
    return m.select(*graph, "i", "j", F.col("v").alias(value))


def upper_vector(entries: DataFrame, graph: Sequence[str], value: str = "value") -> DataFrame:
    """Upper triangle of each matrix as one array ordered by (i, j)."""
    return entries.filter("i < j").groupBy(*graph).agg(
        F.sort_array(F.collect_list(F.struct("i", "j", F.col(value).alias("v")))).alias("_s")).select(*graph, F.col("_s.v").alias("vector"))


def normalize_weights(entries: DataFrame, graph: Sequence[str], mode: str, value: str = "w", eps: float = EPS) -> DataFrame:
    """CON11: 'none', 'absmax', 'minmax' per graph, or 'row_l1' per (graph, i); entries hold both directions for 'row_l1'."""
    w, v = over(list(graph)), F.col(value)
    new = {
        "none": lambda: v,
        "absmax": lambda: v / F.greatest(F.max(F.abs(v)).over(w), F.lit(eps)),
        "minmax": lambda: (v - F.min(v).over(w)) / F.greatest(F.max(v).over(w) - F.min(v).over(w), F.lit(eps)),
        "row_l1": lambda: v / F.greatest(F.sum(F.abs(v)).over(over([*graph, "i"])), F.lit(eps)),
    }[mode]()
    return entries.withColumn(value, new)


def feature_similarity(graphs: DataFrame, metric: str = "cosine", *, gamma: float | None = None, tau: float | None = None,
                       nodes: str = "nodes", carry: Sequence[str] = ("graph_id",)) -> DataFrame:
    """CON12: similarity of node feature vectors for i < j: 'cosine', 'rbf' (exp(-gamma d2), gamma 1 / F, or exp(-d / tau)
    on squared distance d) or 'pearson'. Computed inside each graph row, without a shuffle."""
    prep = {"cosine": a_unit, "pearson": lambda v: a_unit(a_center(v)), "rbf": lambda v: v}[metric]
    g = graphs.select(*carry, F.transform(nodes, prep).alias("_u"))
    g = g.select(*carry, "_u", F.posexplode("_u").alias("i", "_a"))
    g = g.select(*carry, "i", "_a", F.posexplode(F.slice("_u", F.col("i") + 2, F.size("_u"))).alias("_o", "_b"))
    if metric == "rbf":
        d2 = F.aggregate(F.zip_with("_a", "_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
        g_ = F.lit(gamma) if gamma is not None else 1.0 / F.size("_a")
        sim = F.exp(-d2 / F.lit(tau)) if tau is not None else F.exp(-g_ * d2)
    else:
        sim = F.least(F.greatest(a_dot("_a", "_b"), F.lit(-1.0)), F.lit(1.0))
    return g.select(*carry, "i", (F.col("i") + 1 + F.col("_o")).alias("j"), sim.alias("w"))


def fuse_sources(edges: DataFrame, sources: Sequence[tuple], keys: Sequence[str], how: str = "mean") -> DataFrame:
    """CON13: reduce the listed (metric, band) sources; band None stands for the mean over the metric's bands."""
    cond, src = F.lit(False), F.lit(None).cast("int")
    for k, (m, b) in enumerate(sources):
        hit = F.col("metric") == m
        if b is not None:
            hit = hit & (F.col("band") == b)
        cond = cond | hit
        src = F.coalesce(src, F.when(hit, F.lit(k)))
    per = edges.filter(cond).withColumn("_s", src).groupBy(*keys, "i", "j", "_s").agg(F.avg("value").alias("_v"))
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": lambda v: F.percentile(v, F.lit(0.5))}[how]
    return per.groupBy(*keys, "i", "j").agg(agg("_v").alias("value"))


# ---- reductions over subjects, classes, regions -------------------------------------------------

def mean_by_class(edges: DataFrame, *, subject_weighted: bool = True, label: str = "label", value: str = "value",
                  by: Sequence[str] = ("metric", "band", "i", "j")) -> DataFrame:
    """CON14: windows to subject mean to class mean (or windows straight to class mean)."""
    if subject_weighted:
        edges = edges.groupBy(label, "subject_id", *by).agg(F.avg(value).alias(value))
    return edges.groupBy(label, *by).agg(F.avg(value).alias("mean"), F.count_distinct("subject_id").alias("n_subjects"))


def class_contrast(means: DataFrame, *, label: str = "label", by: Sequence[str] = ("metric", "band", "i", "j")) -> DataFrame:
    """CON14: difference of class means for class a < class b; classes meet inside one small group per edge."""
    g = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), F.col("mean").alias("m")))).alias("_g"))
    g = g.select(*by, "_g", F.posexplode("_g").alias("_p", "_a"))
    g = g.select(*by, "_a", F.explode(F.slice("_g", F.col("_p") + 2, F.size("_g"))).alias("_b"))
    return g.select(*by, F.col("_a.c").alias("class_a"), F.col("_b.c").alias("class_b"), (F.col("_a.m") - F.col("_b.m")).alias("difference"))


def subject_summary(edges: DataFrame, *, use_abs: bool = True, value: str = "value", by: Sequence[str] = ("subject_id", "metric", "band")) -> DataFrame:
    """CON15: per subject a 'global' row (mean of the upper triangle) and 'channel' rows (mean strength per node)."""
    e = edges.withColumn("_v", F.abs(value) if use_abs else F.col(value))
    ends = F.array(F.lit(None).cast(dict(edges.dtypes)["i"]), F.col("i"), F.col("j"))
    return (e.select(*by, F.explode(ends).alias("channel"), "_v").groupBy(*by, "channel").agg(F.avg("_v").alias("value"))
            .withColumn("level", F.when(F.col("channel").isNull(), "global").otherwise("channel")))


def _with_regions(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions of both ends; the membership table has one row per channel and region."""
    r = F.broadcast(regions.select(F.col("channel").alias("i"), F.col("region").alias("ri")))
    s = F.broadcast(regions.select(F.col("channel").alias("j"), F.col("region").alias("rj")))
    return edges.join(r, "i").join(s, "j")


def region_matrix(edges: DataFrame, regions: DataFrame, graph: Sequence[str], value: str = "w") -> DataFrame:
    """CON16: mean edge between regions (self pairs excluded); the diagonal is the within-region mean."""
    e = _with_regions(edges, regions)
    a, b = F.least("ri", "rj"), F.greatest("ri", "rj")
    return e.groupBy(*graph, a.alias("region_a"), b.alias("region_b")).agg(F.avg(value).alias("value"), F.count("*").alias("n_edges"))


def within_between(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """CON17: each edge marked 'within' or 'between' by its regions."""
    return _with_regions(edges, regions).withColumn("kind", F.when(F.col("ri") == F.col("rj"), "within").otherwise("between"))

