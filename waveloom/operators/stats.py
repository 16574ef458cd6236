"""Feature tables, summaries and group tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.exprs import EPS, over, random_below, random_hex
from .connectivity import feature_similarity
from .ordered import _same, attach, positions, quantiles, running, tie_table


CHUNK = 1 << 16
PER_TASK = 1 << 20  # draws that one task makes, about

# ---- feature tables -----------------------------------------------------------------------------

def wide_features(long: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """STA01: one row per (keys..) with ``family__feature`` columns; NaN and infinite values become null.

    Give ``names`` (the columns wanted) to save the pass that finds them.
    """
    v = F.when(F.isnan("value") | (F.abs("value") == float("inf")), None).otherwise(F.col("value"))
    p = long.withColumn("_k", F.concat_ws("__", "family", "feature")).withColumn("_v", v).groupBy(*keys)
    return (p.pivot("_k", list(names)) if names else p.pivot("_k")).agg(F.first("_v", ignorenulls=True))


def long_features(wide: DataFrame, keys: Sequence[str], names: Sequence[str], *, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """STA02: unpivot; ``feature_key`` is split at the first ``__``; only finite values; optional seeded row sample."""
    w = wide
    if max_rows is not None:
        w = w.orderBy(random_hex(F.lit(seed), *keys)).limit(max_rows)
    u = w.unpivot(list(keys), list(names), "feature_key", "value").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    parts = F.split("feature_key", "__", 2)
    return u.withColumn("family", F.get(parts, 0)).withColumn("feature", F.get(parts, 1))


def split_class_summary(long: DataFrame, keys: Sequence[str] = ("data_split", "class_label", "feature_key")) -> DataFrame:
    """STA03: n, mean, sample std, min, max per split, class and feature."""
    return long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def connectivity_summary(rows: DataFrame, *, all_bands: bool = True, all_splits: bool = True, all_classes: bool = False, by_band: bool = True) -> DataFrame:
    """STA04: distribution of values for (split, class, metric, band) and for the pooled ALL levels.

    Every row counts once per level it belongs to; quantiles are exact and stay spread, also for ALL.
    """
    levels = lambda name, pooled, base=True: F.array(*([F.col(name)] if base else []), *([F.lit("ALL")] if pooled else []))
    r = rows.withColumn("band", F.coalesce("band", F.lit("none")))
    r = r.withColumn("data_split", F.explode(levels("data_split", all_splits))).withColumn("class_label", F.explode(levels("class_label", all_classes))).withColumn("band", F.explode(levels("band", all_bands, by_band)))
    k = ["data_split", "class_label", "metric", "band"]
    ch = [F.count_distinct("channel").alias("n_channels")] if "channel" in rows.columns else []
    s = r.groupBy(*k).agg(F.count("value").alias("n_values"), F.count_distinct("subject_id").alias("n_subjects"), *ch, F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(r.select(*k, "value"), k, "value", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95})
    return (s.join(q, k).withColumn("sem", F.col("std") / F.sqrt(F.greatest("n_values", F.lit(1)).cast("double"))).withColumn("cv", F.try_divide("std", "mean"))
            .withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("range", F.col("max") - F.col("min")))


def outlier_tracker(wide: DataFrame, artifact: Sequence[str], clinical: Sequence[str] = (), *, limit: float = 3.0, keys: Sequence[str] = ("class_label", "subject_id", "data_split")) -> DataFrame:
    """STA05: subject means; flagged when any artifact feature is more than ``limit`` sample stds above its class mean."""
    cols = [*artifact, *[x for x in clinical if x not in artifact]]
    s = wide.groupBy(*keys).agg(*[f for x in cols for f in (F.avg(x).alias(f"{x}__mean"), F.stddev_samp(x).alias(f"{x}__std"))])
    g = s.groupBy("class_label").agg(*[f for x in artifact for f in (F.avg(f"{x}__mean").alias(f"_m_{x}"), F.stddev_samp(f"{x}__mean").alias(f"_s_{x}"))])
    j = s.join(F.broadcast(g), "class_label")  # one row per class
    hits = []
    for x in artifact:
        j = j.withColumn(f"{x}__class_z", (F.col(f"{x}__mean") - F.col(f"_m_{x}")) / (F.nullif(f"_s_{x}", F.lit(0.0)) + EPS))
        hits.append(F.when(F.col(f"{x}__class_z") > limit, F.lit(f"{x} z>{limit}; ")))
    reasons = F.concat(*[F.coalesce(h, F.lit("")) for h in hits])
    return j.withColumn("outlier_reasons", reasons).withColumn("is_outlier", reasons != "").drop(*[f"_{p}_{x}" for x in artifact for p in "ms"])


def channel_tables(long: DataFrame, channels: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """STA06: subject means, subject x channel means, and one ``channel__feature`` column each per subject."""
    subject = long.groupBy("subject_id", "feature").agg(F.avg("value").alias("value"))
    channel = long.groupBy("subject_id", "channel", "feature").agg(F.avg("value").alias("value"))
    p = channel.withColumn("_k", F.concat_ws("__", "channel", "feature")).groupBy("subject_id")
    flat = (p.pivot("_k", list(channels)) if channels else p.pivot("_k")).agg(F.first("value"))
    return subject, channel, flat


# ---- tests --------------------------------------------------------------------------------------

def anova(rows: DataFrame, keys: Sequence[str] = (), label: str = "label", value: str = "value") -> DataFrame:
    """STA07/STA08: one-way F and p per key from per-class counts, means and variances."""
    g = rows.groupBy(*keys, label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.groupBy(*keys).agg(F.sum("n").alias("_N"), F.count("*").alias("_k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_M"), F.sum(F.col("n") * F.col("v")).alias("_w"))
    j = attach(g, t, list(keys)).groupBy(*keys).agg(F.max("_N").alias("n"), F.max("_k").alias("k"), F.max("_w").alias("_w"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("_M"), F.lit(2))).alias("_b"))
    f = F.try_divide(F.col("_b") / (F.col("k") - 1), F.col("_w") / (F.col("n") - F.col("k")))
    return j.withColumn("f_stat", f).withColumn("p_val", tails.p_f(F.col("f_stat"), F.col("k") - 1, F.col("n") - F.col("k"))).drop("_w", "_b")


def bh_adjust(rows: DataFrame, keys: Sequence[str] = (), p: str = "p_val", out: str = "p_corrected", small: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """STA08: Benjamini-Hochberg adjusted p. ``small``: a key holds few rows (the edges of a montage), one window does;
    otherwise ranks and the minimum from above come from spread running totals over distinct p."""
    if small:
        w = over(list(keys), F.col(p), *[F.col(t) for t in tie])
        r = rows.withColumn("_q", F.col(p) * F.count("*").over(over(list(keys))) / F.row_number().over(w))
        up = over(list(keys), F.col(p).desc(), *[F.col(t).desc() for t in tie]).rowsBetween(-(1 << 63), 0)
        return r.withColumn(out, F.least(F.min("_q").over(up), F.lit(1.0))).drop("_q")
    t = tie_table(rows.select(*keys, p), keys, p)
    n = t.groupBy(*keys).agg(F.sum("ties").alias("_m"))
    # of tied values the largest rank gives the smallest quotient
    q = attach(t, n, list(keys)).withColumn("_q", F.col(p) * F.col("_m") / (F.col("before") + F.col("ties"))).select(*keys, p, "_q")
    low = running(q, keys, [F.desc(p)], {"_low": ("min", F.col("_q"))}).select(*keys, p, "_low")
    return _same(rows, low, [*keys, p]).withColumn(out, F.least("_low", F.lit(1.0))).drop("_low")


def edge_anova(edges: DataFrame, label: str = "label", value: str = "w", alpha: float = 0.05) -> DataFrame:
    """STA08: ANOVA per edge with adjusted p and a significance flag."""
    a = anova(edges, ["i", "j"], label, value)
    return bh_adjust(a, [], small=True, tie=["i", "j"]).withColumn("significant", F.col("p_corrected") < alpha)


def top_edges(tests: DataFrame, edges: DataFrame, n: int, classes: Sequence, label: str = "label", value: str = "w", only_significant: bool = True) -> DataFrame:
    """STA09: the n edges of largest F (among significant ones) with the mean of each class."""
    t = tests.filter("significant") if only_significant else tests
    top = t.orderBy(F.desc("f_stat"), "i", "j").limit(n)
    m = edges.join(F.broadcast(top.select("i", "j")), ["i", "j"]).groupBy("i", "j").agg(*[F.avg(F.when(F.col(label) == k, F.col(value))).alias(f"mean_class_{k}") for k in classes])
    return top.join(m, ["i", "j"])


def class_ties(rows: DataFrame, keys: Sequence[str], classes: Sequence, label: str = "label", value: str = "value") -> DataFrame:
    """Distinct values with their count per class and running counts: the basis of both rank tests."""
    r = rows.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col(label).isin(list(classes)))
    return tie_table(r, keys, value, {f"n{k}": F.when(F.col(label) == k, 1).otherwise(0) for k in classes})


def kruskal(ties: DataFrame, keys: Sequence[str], classes: Sequence, value: str = "value") -> DataFrame:
    """STA10: H with tie correction and p; null when a class is empty, (0, 1) when all values are equal."""
    g = ties.groupBy(*keys).agg(F.sum("ties").alias("_N"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                F.sum(F.pow(F.col("ties").cast("double"), F.lit(3)) - F.col("ties")).alias("_t"),
                                *[F.sum(f"n{k}").alias(f"_n{k}") for k in classes], *[F.sum(F.col("avg_rank") * F.col(f"n{k}")).alias(f"_r{k}") for k in classes])
    n = F.col("_N").cast("double")
    s = F.lit(0.0)
    for k in classes:
        s = s + F.try_divide(F.col(f"_r{k}") * F.col(f"_r{k}"), F.col(f"_n{k}"))
    h = F.try_divide(12 / (n * (n + 1)) * s - 3 * (n + 1), 1 - F.col("_t") / (n * n * n - n))
    empty = F.least(*[F.col(f"_n{k}") for k in classes]) == 0
    flat = F.abs(F.col("_hi") - F.col("_lo")) <= 1e-8 + 1e-5 * F.abs("_lo")
    g = g.withColumn("h_stat", F.when(empty, None).when(flat, 0.0).otherwise(h))
    return g.withColumn("p_val", F.when(empty, None).when(flat, 1.0).otherwise(tails.p_chi2(F.col("h_stat"), F.lit(len(classes) - 1)))).select(*keys, F.col("_N").alias("n"), "h_stat", "p_val")


def mann_whitney(ties: DataFrame, keys: Sequence[str], pairs: Sequence[tuple], value: str = "value", method: str = "asymptotic") -> DataFrame:
    """STA11: U and two-sided p for class pairs; null for an empty class, (0, 1) when all values are equal.

    ``method`` is the caller's choice for all keys: 'asymptotic' is the normal approximation with tie and continuity
    correction, 'exact' counts arrangements (its work grows with n1 n2; ties raise, as the count does not hold for them).
    """
    if method not in ("asymptotic", "exact"):
        raise ValueError(f"unknown method {method!r}")
    rows = F.array(*[F.struct(F.lit(a).alias("class_a"), F.lit(b).alias("class_b"), F.col(f"n{a}").alias("x"), F.col(f"n{b}").alias("y"),
                              (F.col(f"cum_n{b}") - F.col(f"n{b}")).alias("below")) for a, b in pairs])
    t = ties.select(*keys, value, F.explode(rows).alias("e")).select(*keys, value, "e.*").filter("x + y > 0")
    both = (F.col("x") + F.col("y")).cast("double")
    k = [*keys, "class_a", "class_b"]
    g = t.groupBy(*k).agg(F.sum("x").alias("n1"), F.sum("y").alias("n2"), F.sum(F.col("x") * (F.col("below") + F.col("y") / 2)).alias("u"),
                          F.sum(F.pow(both, F.lit(3)) - both).alias("_t"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    top = F.greatest("u", n1 * n2 - F.col("u"))
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_t"), n * (n - 1))))
    z = F.try_divide(top - n1 * n2 / 2 - 0.5, sd)
    near = F.least(F.lit(1.0), F.when(z > 0, tails.p_normal(z)).otherwise(1.0))
    exact = F.when(F.col("_t") > 0, F.raise_error(F.lit("the exact count needs untied values"))).otherwise(tails.p_rank_sum(F.col("u"), n1, n2))
    empty, flat = (F.col("n1") == 0) | (F.col("n2") == 0), F.abs(F.col("_hi") - F.col("_lo")) <= 1e-8 + 1e-5 * F.abs("_lo")
    g = g.withColumn("z_stat", z).withColumn("p_val", F.when(empty, None).when(flat, 1.0).otherwise(near if method == "asymptotic" else exact))
    return g.withColumn("u_stat", F.when(empty, None).when(flat, 0.0).otherwise(F.col("u"))).drop("u", "_t", "_lo", "_hi")


# ---- one subject against controls ---------------------------------------------------------------

def normative(edges: DataFrame, controls: Column, w: str = "w") -> tuple[DataFrame, DataFrame]:
    """STA12: subject mean edges, and mean and sample std (at least 1e-8) over the control subjects."""
    s = edges.groupBy("subject_id", "i", "j").agg(F.avg(w).alias("mean_adj"))
    n = s.filter(controls).groupBy("i", "j").agg(F.avg("mean_adj").alias("mu"), F.greatest(F.stddev_samp("mean_adj"), F.lit(EPS)).alias("sigma"))
    return s, n


def normative_scores(subjects: DataFrame, norms: DataFrame, alpha: float = 0.05) -> DataFrame:
    """STA12: z, two-sided p, and the BH mask per subject (a subject has at most a few hundred edges)."""
    z = subjects.join(F.broadcast(norms), ["i", "j"]).withColumn("z_score", (F.col("mean_adj") - F.col("mu")) / F.col("sigma"))
    z = z.withColumn("p_val", tails.p_normal(F.col("z_score")))
    r = z.withColumn("_r", F.row_number().over(over(["subject_id"], "p_val", "i", "j"))).withColumn("_m", F.count("*").over(over(["subject_id"])))
    cut = F.max(F.when(F.col("p_val") <= alpha * F.col("_r") / F.col("_m"), F.col("p_val"))).over(over(["subject_id"]))
    return r.withColumn("significant", F.coalesce(F.col("p_val") <= cut, F.lit(False))).drop("_r", "_m")


def bootstrap_widths(edges: DataFrame, *, draws: int = 200, low: float = 0.025, high: float = 0.975, seed: int = 0, segment: str = "segment_id", w: str = "w") -> DataFrame:
    """STA13: width of the percentile interval of the mean edge over resampled segments.

    Draws become counts per (subject, draw, segment), so resamples are weighted sums and no resampled copy of the edges is made
    beyond one row per draw before the map-side partial sum.
    """
    seg = positions(edges.select("subject_id", segment).distinct(), ["subject_id"], [segment], "_p")
    size = seg.groupBy("subject_id").agg(F.count("*").alias("_T"))
    # draws are made in chunks of bounded length, spread over the cluster before they are expanded
    d = size.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_T") - 1) / CHUNK))))
    # chunks are small rows, which adaptive execution would gather in one task: their partitions are counted by the draws that they stand for
    total = (size.agg(F.sum("_T")).first()[0] or 0) * draws
    width = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PER_TASK + 1)
    d = d.repartition(width, "subject_id", "_b", "_k").withColumn("_d", F.explode(F.sequence(F.col("_k") * CHUNK, F.least((F.col("_k") + 1) * CHUNK, F.col("_T")) - 1))).drop("_k")
    d = d.withColumn("_p", random_below("_T", F.lit(seed), "subject_id", "_b", "_d")).groupBy("subject_id", "_p", "_b").agg(F.count("*").alias("_c"))
    cnt = d.groupBy("subject_id", "_p").agg(F.collect_list(F.struct("_b", "_c")).alias("_bc"))
    m = seg.join(cnt, ["subject_id", "_p"]).join(size, "subject_id").select("subject_id", segment, "_bc", "_T")
    e = edges.select("subject_id", segment, "i", "j", F.col(w).alias("w")).join(m, ["subject_id", segment])
    boot = e.select("subject_id", "i", "j", "w", "_T", F.explode("_bc").alias("x")).groupBy("subject_id", "i", "j", "x._b").agg((F.sum(F.col("x._c") * F.col("w")) / F.max("_T")).alias("_m"))
    # as many values per edge as there are draws
    q = F.percentile("_m", F.array(F.lit(low), F.lit(high)))
    return boot.groupBy("subject_id", "i", "j").agg(q.alias("_q")).select("subject_id", "i", "j", (F.get("_q", 1) - F.get("_q", 0)).alias("ci_width"))


def stable_edges(widths: DataFrame, keep: float = 0.30) -> DataFrame:
    """STA13: edges whose width is within the smallest share of the subject."""
    cut = F.percentile("ci_width", F.lit(keep)).over(over(["subject_id"]))
    return widths.withColumn("stable", F.col("ci_width") <= cut)


# ---- data set -----------------------------------------------------------------------------------

def dataset_rows(recordings: DataFrame, sfreq: str = "sfreq") -> DataFrame:
    """STA15: one row per recording with channel count and duration."""
    return recordings.withColumn("num_channels", F.size("channels")).withColumn("duration_sec", F.col("n_samples") / F.col(sfreq))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """STA15: one aggregate row."""
    return rows.agg(F.count("*").alias("num_subjects"), F.count_distinct("label_id").alias("num_labels"), F.count_distinct("sfreq").alias("num_rates"),
                    *[f(c_).alias(f"{n}_{c_}") for c_ in ("num_channels", "duration_sec") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def label_counts(segments: DataFrame, label: str = "label") -> DataFrame:
    """STA15: subjects and segments per label, and segments per subject."""
    s = segments.groupBy(label, "subject_id").agg(F.count("*").alias("_n"))
    return s.groupBy(label).agg(F.count("*").alias("n_subjects"), F.sum("_n").alias("n_segments"), F.min("_n").alias("min_segments"), F.max("_n").alias("max_segments"), F.avg("_n").alias("mean_segments"))


def channel_similarity(nodes: DataFrame, label: str = "label") -> DataFrame:
    """STA16: class mean node features, and their correlation between channels."""
    m = nodes.groupBy(label, "node", "feature").agg(F.avg("x").alias("x"))
    v = m.groupBy(label, "node").agg(F.sort_array(F.collect_list(F.struct("feature", "x"))).alias("_f"))
    g = v.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("node", F.col("_f.x").alias("f")))).alias("_n"))
    return feature_similarity(g.select(label, F.col("_n.f").alias("nodes")), "pearson", carry=[label]).withColumnRenamed("w", "corr")


