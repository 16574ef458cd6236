"""Noise scores, clean-window manifests, and the choice of windows per subject.

A manifest has one row per (subject_id, segment_id). Choices of k windows are ranks with a limit, which
Spark applies before the shuffle, so a subject with very many windows sends k rows per task. Seeded
choices follow a hash of the row's key: they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, c, over, pick_first, random_below, random_hex, random_unit
from . import blocks as B
from .landing import land
from .ordered import attach, positions, quantiles

S, SEG = "subject_id", "segment_id"


def key_hash(seed, *cols) -> Column:
    return random_hex(F.lit(seed), *(cols or (S, SEG)))


def _ranks(v: pa.Array) -> np.ndarray:
    """Dense ranks in Spark's ascending order: nulls first (0), NaN last; equal values share one."""
    if pa.types.is_boolean(v.type):
        v = v.cast(pa.int8())
    r = pc.rank(v, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    r[v.is_null().to_numpy(zero_copy_only=False)] = 0
    if pa.types.is_floating(v.type):
        nan = pc.fill_null(pc.is_nan(v), False).to_numpy(zero_copy_only=False)
        r[nan] = len(v) + 1
    return r


def _thin(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, *more: tuple[Sequence[str], Sequence[str], int]) -> DataFrame:
    """Keeps the rows that can be among the first ``k`` of their key, or among those of any further (keys, order, k): a row goes where the rows that
    arrive together with it hold k smaller ones. ``order`` names columns, '-name' is descending (nulls and NaN lie as in Spark).

    Nothing is sorted beyond one Arrow batch, so nothing spills. How many rows go depends on how the rows lie (nearly all that can, where a
    key's rows lie together, as in a stored manifest); those that stay always hold the first k.
    """
    firsts = [(keys, order, k), *more]

    def thin(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = {x: _ranks(batch.column(x)) for x in {x.removeprefix("-") for keys, order, _ in firsts for x in (*keys, *order)}}
            stay = np.zeros(batch.num_rows, bool)
            for keys, order, k in firsts:
                by = [*[ranks[x] for x in keys], *[-ranks[x[1:]] if x[0] == "-" else ranks[x] for x in order]]
                at = np.lexsort(by[::-1])
                new = np.zeros(len(at), bool)
                new[0] = True
                for x in keys:
                    new[1:] |= np.diff(ranks[x][at]) != 0
                row = np.arange(len(at))
                stay[at[row - np.maximum.accumulate(np.where(new, row, 0)) < k]] = True
            yield batch.filter(pa.array(stay))

    return df.mapInArrow(thin, df.schema)


def _pick(df: DataFrame, keys: Sequence[str], *order: Column | tuple[Column, str], k: int = 1, rank: str | None = None) -> DataFrame:
    """As ``pick_first``, but rows that cannot be picked go before the sort. A pair (column, 'desc') is descending."""
    cols = [o if isinstance(o, tuple) else (o, "asc") for o in order]
    names = [f"_o{i}" for i in range(len(cols))]
    d = df.withColumns({n: x for n, (x, _) in zip(names, cols)})
    d = _thin(d, keys, [f"-{n}" if way == "desc" else n for n, (_, way) in zip(names, cols)], k)
    return pick_first(d, keys, *[F.desc(n) if way == "desc" else F.col(n) for n, (_, way) in zip(names, cols)], k=k, rank=rank).drop(*names)


# ---- robust scores ------------------------------------------------------------------------------

def robust_zscore(long: DataFrame, keys: Sequence[str], value: str = "value", positive: bool = False, eps: float = EPS) -> DataFrame:
    """QC06: (x - median) / (1.4826 MAD); a MAD below eps gives IQR / 1.349, then the std, then 0. Adds ``z``."""
    q = quantiles(long, keys, value, {"_med": 0.5, "_q1": 0.25, "_q3": 0.75})
    sd = long.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    j = attach(long, attach(q, sd, keys), keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    mad = quantiles(j.select(*keys, "_dev"), keys, "_dev", {"_mad": 0.5})
    j = attach(j, mad, keys)
    iqr = F.col("_q3") - F.col("_q1")
    scale = F.when(F.col("_mad") < eps, F.when(iqr > eps, iqr / 1.349).otherwise(F.col("_sd"))).otherwise(1.4826 * F.col("_mad"))
    z = F.when(scale < eps, 0.0).otherwise((F.col(value) - F.col("_med")) / scale)
    return j.withColumn("z", F.greatest(z, F.lit(0.0)) if positive else z).drop("_med", "_q1", "_q3", "_sd", "_dev", "_mad")


def mad_threshold(df: DataFrame, keys: Sequence[str], value: str, tau: float = 3.5) -> DataFrame:
    """QC07: median + tau 1.4826 MAD; when the MAD vanishes, q3 + 1.5 IQR. One row per key."""
    q = quantiles(df, keys, value, {"_med": 0.5, "_q1": 0.25, "_q3": 0.75})
    j = attach(df.select(*keys, value), q, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    m = quantiles(j.select(*keys, "_dev"), keys, "_dev", {"_mad": 0.5})
    iqr = F.col("_q3") - F.col("_q1")
    return attach(q, m, keys).select(*keys, F.when(F.col("_mad") < EPS, F.col("_q3") + 1.5 * iqr).otherwise(F.col("_med") + tau * 1.4826 * F.col("_mad")).alias("threshold"))


def connectivity_noise(edges: DataFrame, order: str = SEG, w: str = "w") -> DataFrame:
    """QC08: per window edge mean, std, abs mean, abs max, share of edges at or above the subject's 95th percentile, RMS distance
    to the subject's median edges, and the mean RMS jump to the neighbouring windows."""
    e = edges.select(S, SEG, order, "i", "j", F.coalesce(F.nanvl(F.col(w), F.lit(0.0)), F.lit(0.0)).alias("w")) if order != SEG else edges.select(S, SEG, "i", "j", F.coalesce(F.nanvl(F.col(w), F.lit(0.0)), F.lit(0.0)).alias("w"))
    top = quantiles(e.select(S, F.abs("w").alias("a")), [S], "a", {"_thr": 0.95})
    med = quantiles(e.select(S, "i", "j", "w"), [S, "i", "j"], "w", {"_med": 0.5})
    x = e.join(top, S).join(med, [S, "i", "j"])
    g = x.groupBy(S, SEG).agg(
        F.avg("w").alias("conn_mean"), F.stddev_pop("w").alias("conn_std"), F.avg(F.abs("w")).alias("conn_abs_mean"), F.max(F.abs("w")).alias("conn_abs_max"),
        F.avg(F.when(F.abs("w") >= F.col("_thr"), 1.0).otherwise(0.0)).alias("conn_high_edge_fraction"),
        F.sqrt(F.avg(F.pow(F.col("w") - F.col("_med"), F.lit(2)))).alias("conn_median_distance"))
    at = positions(e.select(S, SEG, *([order] if order != SEG else [])).distinct(), [S], [order], "_n").select(S, SEG, "_n")
    p = e.select(S, SEG, "i", "j", "w").join(at, [S, SEG])
    nxt = p.select(S, (F.col("_n") - 1).alias("_n"), F.col(SEG).alias("_next"), "i", "j", F.col("w").alias("_w2"))
    jump = p.join(nxt, [S, "_n", "i", "j"]).groupBy(S, SEG, "_next").agg(F.sqrt(F.avg(F.pow(F.col("w") - F.col("_w2"), F.lit(2)))).alias("_d"))
    both = jump.select(S, F.explode(F.array(SEG, "_next")).alias(SEG), "_d").groupBy(S, SEG).agg(F.avg("_d").alias("conn_temporal_jump"))
    return g.join(both, [S, SEG], "left").fillna(0.0, ["conn_temporal_jump"])


NODE_NOISE = ("ptp", "abs_kurtosis", "hjorth_complexity")
CONN_NOISE = ("conn_std", "conn_abs_max", "conn_high_edge_fraction", "conn_median_distance", "conn_temporal_jump")


def noise_scores(windows: DataFrame, *, node: Sequence[str] = NODE_NOISE, conn: Sequence[str] = CONN_NOISE, node_weight: float = 0.5,
                 conn_weight: float = 0.5, temperature: float = 1.0, min_weight: float = 0.05) -> DataFrame:
    """QC09: positive robust z of each column within the subject; means of node and connectivity z's; weighted mix; and the
    sampling weight clip(exp(-score / T), min, 1). All columns go through one ranking pass."""
    long = land(windows.unpivot([S, SEG], [*node, *conn], "metric", "value"))
    z = robust_zscore(long, [S, "metric"], positive=True)
    g = z.groupBy(S, SEG).agg(F.avg(F.when(F.col("metric").isin(list(node)), F.col("z"))).alias("node_noise_score"),
                              F.avg(F.when(F.col("metric").isin(list(conn)), F.col("z"))).alias("connectivity_noise_score"))
    mix = (node_weight * F.col("node_noise_score") + conn_weight * F.col("connectivity_noise_score")) / max(node_weight + conn_weight, EPS) if conn else F.col("node_noise_score")
    g = g.withColumn("combined_noise_score", mix)
    return g.withColumn("sampling_weight", F.least(F.greatest(F.exp(-F.col("combined_noise_score") / max(temperature, 1e-6)), F.lit(min_weight)), F.lit(1.0)))


def anomaly_labels(windows: DataFrame, features: Sequence[str], *, trees: int = 200, tau: float = 3.5, seed: int = 42) -> DataFrame:
    """QC10: isolation forest per subject on standardized features; severity = -score; clean when at most the adaptive cut."""
    windows = land(windows.select(S, SEG, *features))
    st = windows.groupBy(S).agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features])
    z = [(F.col(f) - F.col(f"_m_{f}")) / F.when(F.col(f"_s_{f}") < EPS, 1.0).otherwise(F.col(f"_s_{f}")) for f in features]
    v = windows.join(st, S).select(S, SEG, F.array(*z).alias("x"))
    scored = land(B.unpack(B.isolation_forest(B.pack(v, [S], [SEG]), [S], trees=trees, seed=seed), [S], ["iforest_score"]).withColumn("severity", -F.col("iforest_score")))
    cut = mad_threshold(scored, [S], "severity", tau)
    return scored.join(cut, S).withColumn("iforest_is_clean", F.col("severity") <= F.col("threshold"))


def window_state(windows: DataFrame, spectral: str = "spectral", *, dims: int = 5, k: int = 6, starts: int = 20, seed: int = 42) -> DataFrame:
    """QC11: per subject, standardized spectral vectors to ``dims`` components to k clusters; all subjects at once."""
    b = B.pack(windows.select(S, SEG, F.col(spectral).alias("x")), [S], [SEG])
    pb = B.project(b, B.pca_models(b, [S], dims), [S], dims)
    out = B.unpack(B.kmeans(pb, [S], k, starts=starts, seed=seed), [S], ["m", "cluster", "distance"])
    return windows.join(out.withColumnRenamed("m", "spectral_pca"), [S, SEG])


def window_scores(features: DataFrame) -> DataFrame:
    """QC11: channel means of ptp, kurtosis and complexity per window."""
    return features.groupBy(S, SEG).agg(F.avg("ptp").alias("ptp"), F.avg("kurtosis").alias("kurtosis"), F.avg("hjorth_complexity").alias("hjorth_complexity")).withColumn("abs_kurtosis", F.abs("kurtosis"))


# ---- baseline choices and reports ---------------------------------------------------------------

def select_random(m: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """QC12: k windows per subject in hash order."""
    return _pick(m, [S], key_hash(seed), F.col(SEG), k=k, rank="selected_rank")


def select_clean_first(m: DataFrame, k: int, seed: int = 0, clean: str = "keep_clean", score: str = "score") -> DataFrame:
    """QC12: clean windows in hash order, then the rest by score."""
    ok = F.col(clean)
    return _pick(m, [S], F.when(ok, 0).otherwise(1), F.when(ok, key_hash(seed)), (F.when(~ok, F.col(score)), "desc"), F.col(SEG), k=k, rank="selected_rank")


def select_diverse(m: DataFrame, k: int, seed: int = 0, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """QC12: the window nearest to each cluster's centre (by cluster id), then others in hash order."""
    d = _lead_and_fill(m, k, seed, cluster, distance)
    lead = F.col("_in") == 1
    return pick_first(d, [S], F.when(lead, 0).otherwise(1), F.when(lead, F.col(cluster)), F.col("_h"), F.col(SEG), k=k, rank="selected_rank").drop("_in", "_h")


def _lead_and_fill(m: DataFrame, k: int, seed: int, cluster: str, best: str) -> DataFrame:
    """The windows that a choice of k can take when the best of each cluster (``_in`` = 1) come first, then others by hash (``_h``).

    Of r < k representatives, the k - r others that follow are among the first k by hash, because only the r can lie ahead of them besides.
    """
    d = _thin(m.withColumn("_h", key_hash(seed)), [S, cluster], [best, SEG], 1, ([S], ["_h", SEG], k))
    by = F.desc(best[1:]) if best[0] == "-" else F.col(best)
    return d.repartition(S).withColumn("_in", F.row_number().over(over([S, cluster], by, F.col(SEG))))


def _merge(rep: DataFrame, fill: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """Representatives before fill rows, each window once, k per subject."""
    u = pick_first(rep.unionByName(fill), [S, SEG], F.col("_tier"))
    return pick_first(u, [S], F.col("_tier"), *order, k=k, rank="selected_rank").drop("_tier")


def top_up(picked: DataFrame, k: int | Column, seed: int = 0, by: Sequence[str] = (S,)) -> DataFrame:
    """Exactly k rows per group: picks by rank, then draws with replacement among them (only a group with fewer than k rows
    has missing ranks, so its picks are all its rows)."""
    rest = [x for x in picked.columns if x not in (*by, "selected_rank")]
    g = picked.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("selected_rank", *rest))).alias("_p"))
    kk = F.lit(k) if isinstance(k, int) else k
    g = g.select(*by, "_p", F.explode(F.sequence(F.lit(1), kk)).alias("_r"))
    at = F.when(F.col("_r") <= F.size("_p"), F.col("_r") - 1).otherwise(random_below(F.size("_p"), F.lit(seed), F.lit("up"), *by, "_r"))
    g = g.withColumn("_s", F.get("_p", at.cast("int")))
    return g.select(*by, *[F.col(f"_s.{x}").alias(x) for x in rest], F.col("_r").alias("selected_rank"))


def coverage(selected: DataFrame, n_clusters: int, k: int, cluster: str = "cluster", metrics: Sequence[str] = ("ptp",)) -> DataFrame:
    """QC13: per subject and method: count, share of clusters represented, metric means, chosen ids in rank order."""
    return selected.groupBy(S, "method").agg(
        F.count("*").alias("num_selected"), (100.0 * F.count_distinct(cluster) / min(n_clusters, k)).alias("cluster_coverage_pct"), *[F.avg(x).alias(f"mean_{x}") for x in metrics],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("selected_rank", SEG))), lambda s: s[SEG].cast("string")), ",").alias("segment_ids"))


def coverage_by_method(per_subject: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return per_subject.groupBy("method").agg(*[F.avg(x).alias(x) for x in metrics])


# ---- clean-cluster manifests --------------------------------------------------------------------

def cluster_diagnostics(m: DataFrame, *, cluster: str = "cluster", clean: str = "iforest_is_clean", label: str = "label") -> DataFrame:
    """QC14: size, fraction, mean and exact median ptp, mean |kurtosis|, share of anomalies per (subject, cluster)."""
    k = [S, cluster]
    g = m.groupBy(label, *k).agg(F.count("*").alias("cluster_size"), F.avg("ptp").alias("mean_ptp"), F.avg("abs_kurtosis").alias("mean_abs_kurtosis"),
                                 F.avg(F.when(F.col(clean), 0.0).otherwise(1.0)).alias("anomaly_fraction"))
    n = m.groupBy(S).agg(F.count("*").alias("_n"))
    return g.join(quantiles(m, k, "ptp", {"median_ptp": 0.5}), k).join(n, S).withColumn("cluster_fraction", F.col("cluster_size") / F.col("_n")).drop("_n")


def flag_clusters(diag: DataFrame, *, anomaly: float = 0.6, ptp_q: float = 0.75, kurt_q: float = 0.75) -> DataFrame:
    """QC14: artifact-like when most windows are anomalies, or ptp and |kurtosis| are both in the upper quarter of all clusters."""
    q = attach(quantiles(diag, [], "mean_ptp", {"_p": ptp_q}), quantiles(diag, [], "mean_abs_kurtosis", {"_k": kurt_q}), [])
    return attach(diag, q, []).withColumn("artifact_like_cluster", (F.col("anomaly_fraction") >= anomaly) | ((F.col("mean_ptp") >= F.col("_p")) & (F.col("mean_abs_kurtosis") >= F.col("_k")))).drop("_p", "_k")


def cluster_rollup(flagged: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """QC14: per subject, and class means of the subject shares."""
    bad = F.col("artifact_like_cluster")
    s = flagged.groupBy(label, S).agg(F.count("*").alias("num_clusters"), F.sum(bad.cast("int")).alias("num_artifact_like_clusters"), F.avg(bad.cast("double")).alias("artifact_like_cluster_fraction"),
                                      (F.sum(F.when(bad, F.col("cluster_size")).otherwise(0)) / F.sum("cluster_size")).alias("artifact_segment_fraction"))
    return s, s.groupBy(label).agg(F.avg("artifact_like_cluster_fraction").alias("artifact_like_cluster_fraction"), F.avg("artifact_segment_fraction").alias("artifact_segment_fraction"))


def clean_manifest(segments: DataFrame, diag: DataFrame, noise: DataFrame | None = None, *, cluster: str = "cluster", anomaly: float = 1.0, min_size: int = 1) -> DataFrame:
    """QC15: one row per window with its cluster's facts; kept unless its cluster is (nearly) all anomalies and large enough."""
    d = diag.select(S, cluster, "cluster_size", "cluster_fraction", F.col("anomaly_fraction").alias("cluster_anomaly_fraction"),
                    ((F.col("anomaly_fraction") >= anomaly) & (F.col("cluster_size") >= min_size)).alias("artifact_cluster"))
    m = segments.join(d, [S, cluster]).withColumn("clean_cluster", ~F.col("artifact_cluster")).withColumn("keep_clean", ~F.col("artifact_cluster"))
    return m.join(noise, [S, SEG], "left") if noise is not None else m


def manifest_by_subject(m: DataFrame, metrics: Sequence[str], *, cluster: str = "cluster", deny: DataFrame | None = None) -> DataFrame:
    """QC16: kept and removed counts, cluster counts and conditional means per subject; listed subjects can be left out."""
    if deny is not None:
        m = m.join(deny.select(S), S, "left_anti")
    keep, bad = F.col("keep_clean"), F.col("artifact_cluster")
    means = [f for x in metrics for f in (F.avg(x).alias(f"mean_{x}_all"), F.avg(F.when(keep, F.col(x))).alias(f"mean_{x}_clean"), F.avg(F.when(~keep, F.col(x))).alias(f"mean_{x}_removed"))]
    return m.groupBy("split", "label", S).agg(F.count("*").alias("num_segments_total"), F.sum(keep.cast("int")).alias("num_segments_clean"), F.sum((~keep).cast("int")).alias("num_segments_removed"),
                                              F.avg((~keep).cast("double")).alias("removed_fraction"), F.count_distinct(cluster).alias("num_clusters_total"), F.count_distinct(F.when(bad, F.col(cluster))).alias("num_artifact_clusters"), *means)


def manifest_by_class(subjects: DataFrame) -> DataFrame:
    """QC16: class means of every numeric column of the subject table."""
    cols = [x for x in subjects.columns if x not in ("split", "label", S)]
    return subjects.groupBy("split", "label").agg(*[F.avg(x).alias(x) for x in cols])


def too_few_clean(subjects: DataFrame, minimum: int = 10) -> DataFrame:
    """QC16: subjects with fewer than ``minimum`` clean windows."""
    return subjects.filter(F.col("num_segments_clean") < minimum)


def weight_summary(m: DataFrame, *, clean_only: bool = True, weight: str = "sampling_weight") -> DataFrame:
    """QC17: quartiles, mean, population std and effective sample size of weights per subject."""
    d = m.filter("keep_clean") if clean_only else m
    w = F.col(weight)
    g = d.groupBy(S).agg(F.first("split").alias("split"), F.min("label").alias("label"), F.count("*").alias("num_segments"), F.min(w).alias("weight_min"), F.avg(w).alias("weight_mean"), F.max(w).alias("weight_max"),
                         F.stddev_pop(w).alias("weight_std"), F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)).alias("effective_sample_size"))
    g = g.withColumn("effective_fraction", F.col("effective_sample_size") / F.col("num_segments"))
    return g.join(quantiles(d, [S], weight, {"weight_q25": 0.25, "weight_median": 0.5, "weight_q75": 0.75}), S)


def top_weights(m: DataFrame, k: int = 10, *, clean_only: bool = True, weight: str = "sampling_weight", metrics: Sequence[str] = ("sampling_weight",)) -> tuple[DataFrame, DataFrame]:
    """QC18: the k windows of largest weight per subject with rank, and their mean, sample std, min, max."""
    t = _pick(m.filter("keep_clean") if clean_only else m, [S], (F.col(weight), "desc"), F.col(SEG), k=k, rank="top_rank")
    return t, t.groupBy(S, "label").agg(*[f(x).alias(f"{x}_{n}") for x in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])


def keep_clean_filter(graphs: DataFrame, m: DataFrame, *, default: bool | None = None) -> DataFrame:
    """QC19: graphs whose manifest row is clean. Ids match as they are or without the split prefix; ``default`` decides for graphs
    without a row (None drops them)."""
    from .projections import without_prefix

    own = F.col(S).cast("string")
    mm = m.select(F.col(S).cast("string").alias("_id"), F.col(SEG).alias("_seg"), F.col("keep_clean").alias("_keep"))
    j = graphs.withColumns({"_own": own, "_bare": without_prefix(own)})
    for k, name in enumerate(("_own", "_bare")):  # the exact id wins
        r = mm.select(F.col("_id").alias(name), F.col("_seg").alias(SEG), F.col("_keep").alias(f"_keep{k}"))
        j = j.join(r, [name, SEG], "left")
    keep = F.coalesce("_keep0", "_keep1", F.lit(bool(default)))
    return j.filter(keep).select(*graphs.columns)


def noise_clusters(m: DataFrame, *, cluster: str = "cluster", distance: str = "distance", min_size: int = 50, min_clean: float = 0.5, far_q: float = 0.95) -> DataFrame:
    """QC20: clusters that are small, mostly unclean, or with a median distance above the global 95th percentile."""
    g = m.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(F.col("keep_clean").cast("double")).alias("clean_rate"))
    j = attach(g.join(quantiles(m, [cluster], distance, {"median_distance": 0.5}), cluster), quantiles(m, [], distance, {"_far": far_q}), [])
    return j.withColumn("is_noise", (F.col("n") < min_size) | (F.col("clean_rate") < min_clean) | (F.col("median_distance") > F.col("_far"))).drop("_far")


# ---- cluster-guided choices ---------------------------------------------------------------------

def cluster_balanced(m: DataFrame, k: int = 10, seed: int = 42, cluster: str = "cluster", replace: bool = True) -> DataFrame:
    """QC21: one random window per cluster in random cluster order, then unused windows in random order, then with replacement.

    Only the first k of a cluster can be chosen, so that limit comes first.
    """
    h = key_hash(seed)
    r = _pick(m, [S, cluster], h, F.col(SEG), k=k, rank="_in")
    tier = F.when(F.col("_in") == 1, 0).otherwise(1)
    p = pick_first(r, [S], tier, F.when(tier == 0, random_hex(F.lit(seed), F.lit("c"), S, cluster)), h, F.col(SEG), k=k, rank="selected_rank").drop("_in")
    return top_up(p, k, seed) if replace else p


def _allocate(k: int, alpha: float, mix: float, cap: float | None, min_one: bool, min_size: int):
    """Sequential draw of k slots over the clusters of one subject (a handful of sizes), by one uniform number per slot."""

    def one(size: np.ndarray, u: np.ndarray) -> np.ndarray:
        use = size >= min_size
        if not use.any():
            use[:] = True
        w = np.where(use, np.maximum(size**alpha, EPS), 0.0)
        w /= w.sum()
        w = np.where(use, (1 - mix) * w + mix / use.sum(), 0.0)
        w /= w.sum()
        got = np.zeros(len(size), int)
        if min_one and use.sum() <= k:
            got[use] = 1
        limit = np.inf if cap is None else max(1, int(np.ceil(cap * k)))
        for slot in range(k - got.sum()):
            free = use & (got < size)
            open_ = free & (got < limit)
            pool = open_ if open_.any() else free
            if not pool.any():
                break
            p = np.cumsum(np.where(pool, w, 0.0))
            got[int(np.searchsorted(p, u[slot] * p[-1], side="right"))] += 1
        return got

    @F.pandas_udf("array<bigint>")
    def fn(sizes: pd.Series, units: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(n, float), np.asarray(u, float)) for n, u in zip(sizes, units)], dtype=object)

    return fn


def allocate_clusters(m: DataFrame, k: int = 10, *, alpha: float = 0.5, mix: float = 0.05, cap: float | None = 0.6, min_one: bool = False, min_size: int = 1, seed: int = 42, cluster: str = "cluster") -> DataFrame:
    """QC22: slots per (subject, cluster) in proportion to size^alpha, mixed with a uniform share, at most a share of k each."""
    n = m.groupBy(S, F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    # clusters by id, one without id last
    g = n.groupBy(S).agg(F.sort_array(F.collect_list(F.struct(F.col("cluster").isNull().alias("none"), "cluster", "n"))).alias("_c"))
    units = F.transform(F.sequence(F.lit(0), F.lit(max(k - 1, 0))), lambda i: random_unit(F.lit(seed), F.lit("slot"), S, i))
    g = g.withColumn("_a", _allocate(k, alpha, mix, cap, min_one, min_size)(F.transform("_c", lambda x: x["n"]), units))
    return g.select(S, F.explode(F.arrays_zip("_c", "_a")).alias("_e")).select(S, "_e._c.cluster", "_e._c.n", F.col("_e._a").alias("allocated"))


def cluster_proportional(m: DataFrame, k: int = 10, *, seed: int = 42, cluster: str = "cluster", weight: str | None = None, replace: bool = True, **kw) -> DataFrame:
    """QC22: allocated windows of each cluster (random, or by keyed weights), then unused windows, then with replacement."""
    a = allocate_clusters(m, k, seed=seed, cluster=cluster, **kw).select(S, F.col("cluster").alias(cluster), "allocated")
    order = [F.desc("_key"), F.col(SEG)]  # of the second choice, among at most k rows per cluster
    u = random_unit(F.lit(seed), S, SEG)
    w = F.greatest(F.coalesce(F.nanvl(F.col(weight), F.lit(0.0)), F.lit(0.0)), F.lit(EPS)) if weight else F.lit(1.0)
    r = _pick(m.withColumn("_key", F.ln(F.greatest(u, F.lit(1e-300))) / w), [S, cluster], (F.col("_key"), "desc"), F.col(SEG), k=k, rank="_in").join(a, [S, cluster], "left")
    p = pick_first(r, [S], F.when(F.col("_in") <= F.coalesce("allocated", F.lit(0)), 0).otherwise(1), *order, k=k, rank="selected_rank").drop("_in", "_key", "allocated")
    return top_up(p, k, seed) if replace else p


def weighted_sample(m: DataFrame, k: int = 10, seed: int = 42, weight: str = "sampling_weight") -> DataFrame:
    """QC23: k clean windows without replacement with chances by weight: the largest ln(u) / w."""
    w = F.greatest(F.coalesce(F.nanvl(F.col(weight), F.lit(0.0)), F.lit(0.0)), F.lit(EPS))
    key = F.ln(F.greatest(random_unit(F.lit(seed), S, SEG), F.lit(1e-300))) / w
    return _pick(m.filter("keep_clean").withColumn("_key", key), [S], (F.col("_key"), "desc"), F.col(SEG), k=k, rank="selected_rank").drop("_key")


def representative_scored(m: DataFrame, k: int = 10, score: str = "sampling_weight", cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """QC24: the best score / (1 + distance) of each cluster, best first; then the best of the rest."""
    r = m.withColumn("rep_score", F.col(score) / (1 + F.col(distance)))
    r = _pick(r, [S, cluster], (F.col("rep_score"), "desc"), F.col(SEG), k=k, rank="_in")
    return pick_first(r, [S], F.when(F.col("_in") == 1, 0).otherwise(1), F.desc("rep_score"), F.col(SEG), k=k, rank="selected_rank").drop("_in")


def clean_kmeans(m: DataFrame, k: int = 10, seed: int = 42, cluster: str = "cluster", distance: str | None = "distance", score: str = "score") -> DataFrame:
    """QC25: of clean windows, the nearest (or best scored) of each cluster, larger clusters first; then random fill."""
    d = m.filter("keep_clean")
    size = d.groupBy(S, cluster).agg(F.count("*").alias("cluster_size"))
    d = _lead_and_fill(d, k, seed, cluster, distance if distance else f"-{score}")
    d = attach(d, size, [S, cluster])
    lead = F.col("_in") == 1
    return pick_first(d, [S], F.when(lead, 0).otherwise(1), F.when(lead, F.col("cluster_size")).desc(), F.when(lead, F.col(cluster)), F.col("_h"), F.col(SEG), k=k, rank="selected_rank").drop("_in", "_h")


def cluster_label_table(m: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """QC26: share of each label in a cluster and the cluster's entropy over all labels divided by its maximum."""
    n = m.groupBy(cluster, label).agg(F.count("*").alias("_n"))
    t = n.groupBy(cluster).agg(F.sum("_n").alias("_t"))
    k = n.agg(F.count_distinct(label).alias("_k"))
    p = attach(n.join(t, cluster), k, []).withColumn("p", F.col("_n") / F.col("_t"))
    # labels absent from a cluster count with the floor 1e-12, as the others are floored
    floor = 1e-12
    h = p.groupBy(cluster).agg((F.sum(-F.greatest("p", F.lit(floor)) * F.log2(F.greatest("p", F.lit(floor)))) + (F.max("_k") - F.count("*")) * (-floor * float(np.log2(floor)))).alias("_h"), F.max("_k").alias("_k2"))
    return p.select(cluster, label, "p").join(h.select(cluster, (F.col("_h") / F.when(F.col("_k2") > 1, F.log2(F.col("_k2").cast("double"))).otherwise(1.0)).alias("entropy_norm")), cluster)


def label_aligned(m: DataFrame, k: int = 10, *, seed: int = 42, epoch: int = 0, random_share: float = 0.0, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """QC26: windows from clusters ranked by share of the subject's label, low entropy, subject count, id; with ``random_share`` part
    of the k are random windows of the subject. Reads labels: for training rows only."""
    table = cluster_label_table(m, cluster, label)
    n = m.groupBy(S, cluster).agg(F.count("*").alias("_ns"))
    h = key_hash(seed, F.lit(epoch), S, SEG)
    r = _pick(m, [S, cluster], h, F.col(SEG), k=k)
    r = r.join(table, [cluster, label], "left").join(n, [S, cluster])
    k_rand = min(max(int(round(k * random_share)), 0), k)
    lead = pick_first(r, [S], F.desc(F.coalesce("p", F.lit(0.0))), F.col("entropy_norm"), F.desc("_ns"), F.col(cluster), h, F.col(SEG), k=k - k_rand).drop("p", "entropy_norm", "_ns") if k > k_rand else None
    if lead is None:
        return select_random(m, k, seed)
    if k_rand == 0:
        return lead.withColumn("selected_rank", F.row_number().over(over([S], h, F.col(SEG))))
    fill = _pick(m, [S], key_hash(seed, F.lit("r"), F.lit(epoch), S, SEG), F.col(SEG), k=k).withColumn("_tier", F.lit(1))
    return _merge(lead.withColumn("_tier", F.lit(0)).select(fill.columns), fill, k, [key_hash(seed, F.lit("r"), F.lit(epoch), S, SEG), F.col(SEG)])


def label_aware_k(subjects: DataFrame, base_k: int, max_k: int | None = None, label: str = "label") -> DataFrame:
    """QC27: k per label = ceil(largest class x base_k / class size), capped. One row per label."""
    n = subjects.groupBy(label).agg(F.count("*").alias("n_subjects"))
    k = F.ceil(F.max("n_subjects").over(over([])) * base_k / F.col("n_subjects"))
    return n.withColumn("k", F.least(k, F.lit(max_k)) if max_k is not None else k)


def bags(m: DataFrame, k: int = 10, *, epochs: int = 1, seed: int = 42, strategy: str = "original_random_k", weight: str = "sampling_weight", cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """QC28: one bag per (epoch, subject): exactly k windows, with replacement where a subject has fewer; 'all_clean' keeps all.

    Strategies: original_random_k, clean_random_k, weighted, kmeans, all_clean.
    """
    d = m if strategy == "original_random_k" else m.filter("keep_clean")
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if strategy == "all_clean":
        return d
    h = random_hex(F.lit(seed), "epoch", S, SEG)
    if strategy == "weighted":
        order = [(F.ln(F.greatest(random_unit(F.lit(seed), "epoch", S, SEG), F.lit(1e-300))) / F.greatest(F.col(weight), F.lit(EPS)), "desc")]
    elif strategy == "kmeans":
        near = _pick(d, ["epoch", S, cluster], F.col(distance), F.col(SEG), k=k, rank="_in")
        p = pick_first(near, ["epoch", S], F.when(F.col("_in") == 1, 0).otherwise(1), h, F.col(SEG), k=k, rank="selected_rank").drop("_in")
        return top_up(p, k, seed, ["epoch", S])
    elif strategy in ("original_random_k", "clean_random_k"):
        d = _thin(d.withColumn("_h", h), ["epoch", S], ["_h", SEG], k)
        return top_up(pick_first(d, ["epoch", S], F.col("_h"), F.col(SEG), k=k, rank="selected_rank").drop("_h"), k, seed, ["epoch", S])
    else:
        raise ValueError(f"unknown bag strategy {strategy!r}")
    return top_up(_pick(d, ["epoch", S], *order, F.col(SEG), k=k, rank="selected_rank"), k, seed, ["epoch", S])


def _distinct_draws(count: Column, n: Column, *key) -> Column:
    """``count`` distinct numbers below n (all of them when n is smaller): repeated draws without repeats, then any missing ones in order."""
    tries = F.transform(F.sequence(F.lit(0), 8 * count), lambda i: F.floor(F.conv(F.substring(F.md5(F.concat_ws("|", *[c(k).cast("string") for k in key], i.cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52) * n).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.least(n, count).cast("long") - 1)
    return F.slice(F.array_distinct(F.concat(tries, every)), 1, F.least(count, n).cast("int"))


def pseudo_bags(m: DataFrame, *, n_bags: int, k: int = 10, subjects_per_bag: int = 4, max_per_subject: int = 4, cluster: str | None = None, min_segments: int = 30, min_subjects: int = 5, seed: int = 42, epoch: int = 0) -> DataFrame:
    """QC29: bags of k windows from up to m subjects of one class (and one cluster): rows (bag, label, [cluster], slot, subject, segment).

    Bags draw places in numbered lists of subjects and windows, so nothing is a product of bags and subjects.
    """
    g = ["label"] + ([cluster] if cluster else [])
    pools = m.groupBy(*g).agg(F.count("*").alias("_segs"), F.count_distinct(S).alias("_subs"))
    if cluster:
        pools = pools.filter((F.col("_segs") >= min_segments) & (F.col("_subs") >= min_subjects))
    pools = pools.withColumn("_pool", F.row_number().over(over([], *g)) - 1).withColumn("_pools", F.count("*").over(over([])))
    bag = m.sparkSession.range(n_bags).withColumnRenamed("id", "bag")
    b = bag.join(pools, F.pmod(F.col("bag"), F.col("_pools")) == F.col("_pool")).drop("_pool", "_pools")
    per = F.least(F.greatest(F.ceil(F.lit(k) / F.least("_subs", F.lit(subjects_per_bag))), F.lit(1)), F.lit(max_per_subject))
    b = b.withColumn("_take", per).withColumn("_who", _distinct_draws(F.lit(subjects_per_bag), F.col("_subs"), F.lit(seed), F.lit(epoch), "bag"))
    b = b.select("*", F.posexplode("_who").alias("_w", "_sp"))
    subs = m.groupBy(*g, S).agg(F.count("*").alias("_n"))
    subs = positions(subs, g, [S], "_sp")
    b = b.join(subs, [*g, "_sp"])
    want = F.greatest(F.least(F.col("_take"), k - F.col("_w") * F.col("_take")), F.lit(0))
    pos = _distinct_draws(want, F.col("_n"), F.lit(seed), F.lit(epoch), F.lit("s"), "bag", "_w")
    # a subject with fewer windows than asked gives repeats
    slots = F.when(want > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), want), lambda r: F.get(pos, F.pmod(r - 1, F.size(pos)).cast("int"))))
    b = b.select("bag", *g, S, "_w", "_take", F.posexplode(slots).alias("_r", "_gp")).withColumn("slot", (F.col("_w") * F.col("_take") + F.col("_r")).cast("long"))
    seg = positions(m.select(*g, S, SEG), [*g, S], [SEG], "_gp")
    main = b.join(seg, [*g, S, "_gp"]).select("bag", *g, "slot", S, SEG)
    # slots that the chosen subjects could not fill come from the whole pool
    fill = bag.join(pools, F.pmod(F.col("bag"), F.col("_pools")) == F.col("_pool")).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    fill = fill.join(main.select("bag", "slot"), ["bag", "slot"], "left_anti").withColumn("_gp", random_below("_segs", F.lit(seed), F.lit(epoch), F.lit("f"), "bag", "slot"))
    pool = positions(m.select(*g, S, SEG), g, [S, SEG], "_gp")
    return main.unionByName(fill.join(pool, [*g, "_gp"]).select("bag", *g, "slot", S, SEG))


def diversity(draws: DataFrame, cluster: str = "cluster") -> tuple[DataFrame, DataFrame, DataFrame]:
    """QC30: per epoch, per subject, and overall: draws, unique windows and clusters, ratios. The draws are made and written once."""
    draws = land(draws.select("epoch", S, "label", SEG, cluster))
    e = draws.groupBy("epoch").agg(F.count("*").alias("num_draws"), F.count_distinct(S).alias("num_subjects"), F.count_distinct(SEG).alias("unique_segments"), F.count_distinct(cluster).alias("unique_clusters"))
    e = e.withColumn("mean_bag_size", F.col("num_draws") / F.col("num_subjects")).withColumn("unique_segment_ratio", F.col("unique_segments") / F.greatest("num_draws", F.lit(1)))
    s = draws.groupBy(S, "label").agg(F.count("*").alias("total_draws"), F.count_distinct(SEG).alias("unique_segments"), F.count_distinct(cluster).alias("unique_clusters"), F.count_distinct("epoch").alias("num_epochs"))
    s = s.withColumn("unique_segment_ratio", F.col("unique_segments") / F.greatest("total_draws", F.lit(1)))
    g = draws.agg(F.count_distinct("epoch").alias("probe_epochs"), F.count_distinct(S).alias("num_subjects"), F.count("*").alias("total_draws"), F.count_distinct(S, SEG).alias("unique_segments_total"), F.count_distinct(cluster).alias("unique_clusters_total"))
    g = attach(g, s.agg(F.avg("unique_segment_ratio").alias("mean_subject_unique_segment_ratio")), [])
    g = attach(g, e.agg(F.avg("unique_segment_ratio").alias("mean_epoch_unique_segment_ratio")), [])
    return e, s, g


# ---- splits -------------------------------------------------------------------------------------

def stratified_folds(subjects: DataFrame, n_splits: int, *, val_ratio: float = 0.2, seed: int = 42, label: str = "label") -> DataFrame:
    """QC31: (fold, subject, role): test by stratified fold; of the others a stratified share is val. Raises when a class has fewer
    subjects than folds."""
    small = subjects.groupBy(label).agg(F.count("*").alias("_c")).agg(F.min("_c").alias("_least"))
    s = positions(subjects.select(S, label).withColumn("_h", random_hex(F.lit(seed), S)), [label], ["_h", S], "_p").withColumn("test_fold", F.pmod("_p", F.lit(n_splits)))
    s = attach(s, small, []).withColumn("test_fold", F.when(F.col("_least") < n_splits, F.raise_error(F.lit("more folds than subjects in the smallest class"))).otherwise(F.col("test_fold"))).select(S, label, "test_fold")
    f = s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rest = f.filter("test_fold <> fold").withColumn("_h", random_hex(F.lit(seed), F.lit("val"), "fold", S))
    rest = positions(rest, ["fold", label], ["_h", S], "_q")
    n = rest.groupBy("fold", label).agg(F.count("*").alias("_n"))
    rest = rest.join(F.broadcast(n), ["fold", label]).withColumn("role", F.when(F.col("_q") < F.round(F.col("_n") * F.lit(val_ratio)), "val").otherwise("train"))
    return f.filter("test_fold = fold").select("fold", S, label, F.lit("test").alias("role")).unionByName(rest.select("fold", S, label, "role"))


def split_records(records: DataFrame, folds: DataFrame) -> DataFrame:
    """QC32: records with the role of their subject in each fold."""
    return records.join(folds.select("fold", S, "role"), S)


def first_per_subject(m: DataFrame, order: str = "start_sample") -> DataFrame:
    """QC33: the earliest window per subject."""
    return pick_first(m, [S], F.col(order), F.col(SEG))


STRATEGIES = {
    "keep_clean": lambda m, k, seed: m.filter("keep_clean"),
    "random_k": select_random,
    "clean_first": select_clean_first,
    "diverse": select_diverse,
    "global_cluster_random_k": cluster_balanced,
    "global_cluster_proportional_random_k": lambda m, k, seed: cluster_proportional(m, k, seed=seed),
    "weighted_k": weighted_sample,
    "global_cluster_scored_k": lambda m, k, seed: representative_scored(m, k),
    "clean_kmeans_k": clean_kmeans,
    "label_aligned_k": lambda m, k, seed: label_aligned(m, k, seed=seed),
    "mixed_random_label_aligned_k": lambda m, k, seed: label_aligned(m, k, seed=seed, random_share=0.5),
    "original_random_k": lambda m, k, seed: bags(m, k, seed=seed),
    "clean_random_k": lambda m, k, seed: bags(m, k, seed=seed, strategy="clean_random_k"),
}


def select(m: DataFrame, strategy: str, k: int = 10, seed: int = 42) -> DataFrame:
    """QC34: a named strategy on a manifest."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](m, k, seed)


