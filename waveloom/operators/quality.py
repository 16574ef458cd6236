"""Window quality: metrics, flags with reasons, removal of bad windows, subject and class summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, a_mean, a_moment, a_sum, a_var, kurtosis_corrected, pick_first, random_hex
from ..functions.fixed import FLAT_STD_UV, KURTOSIS_LIMIT, QC_LIMITS
from .ordered import quantiles

WKEYS = ("subject_id", "segment_id")


def window_metrics(windows: DataFrame, keys: Sequence[str] = WKEYS, x: str = "x", *, flat_std: float = FLAT_STD_UV,
                   kurtosis_limit: float = KURTOSIS_LIMIT) -> DataFrame:
    """QC01: largest amplitude and peak-to-peak, global std, shares of flat and of high-kurtosis channels."""
    n = F.size(x)
    w = windows.withColumn("_m2", a_moment(x, 2)).withColumn("_m4", a_moment(x, 4))
    g2 = F.try_divide(F.col("_m4"), F.col("_m2") * F.col("_m2")) - 3
    w = w.select(*keys, n.alias("_n"), F.sqrt("_m2").alias("_std"), kurtosis_corrected(n, g2).alias("_kurt"),
                 (F.array_max(x) - F.array_min(x)).alias("_ptp"),
                 F.greatest(F.abs(F.array_max(x)), F.abs(F.array_min(x))).alias("_abs"), a_mean(x).alias("_mean"),
                 F.col("_m2"), *[k for k in ("start_sample", "end_sample") if k in windows.columns])
    # channels of a window are equally long, so the global variance is mean of variances + variance of means
    return w.groupBy(*keys).agg(
        F.max("_abs").alias("max_abs_uv"), F.max("_ptp").alias("max_ptp_uv"), F.max("_ptp").alias("peak_to_peak_uv"),
        F.percentile("_ptp", F.lit(0.5)).alias("median_ptp_uv"),
        F.sqrt(F.avg("_m2") + F.var_pop("_mean")).alias("global_std_uv"),
        F.avg(F.when(F.col("_std") < flat_std, 1.0).otherwise(0.0)).alias("flat_channel_frac"),
        F.avg(F.when(F.col("_kurt") > kurtosis_limit, 1.0).otherwise(0.0)).alias("high_kurtosis_frac"),
        F.count("*").alias("num_channels"), F.max("_n").alias("num_samples"))


def flag_windows(metrics: DataFrame, limits: Sequence[tuple[str, float]] = tuple(QC_LIMITS)) -> DataFrame:
    """QC02: strict limits; reasons joined by ';' in the order of the limits."""
    bad = None
    reasons = []
    for name, lim in limits:
        hit = F.col(name) > lim
        bad = hit if bad is None else bad | hit
        reasons.append(F.when(hit, F.lit(f"{name}>{lim}")))
    return metrics.withColumn("bad_segment_flag", bad).withColumn("noise_flag", bad).withColumn(
        "artifact_reasons", F.concat_ws(";", *reasons))


def drop_bad_windows(flags: DataFrame, *, min_valid: int = 1, max_windows: int | None = None, seed: int = 0,
                     subject: str = "subject_id", segment: str = "segment_id") -> tuple[DataFrame, DataFrame]:
    """QC03: windows that stay, and one summary row per subject.

    A subject with fewer than ``min_valid`` good windows is dropped; ``max_windows`` keeps a seeded
    choice. Counts come from a partial aggregate joined back, not from a window over the subject.
    """
    good = (~F.col("bad_segment_flag")).cast("long")
    count = flags.groupBy(subject).agg(F.count("*").alias("n_windows"), F.sum(good).alias("n_good"))
    kept = flags.filter(~F.col("bad_segment_flag")).join(count.filter(F.col("n_good") >= min_valid).select(subject), subject)
    if max_windows is not None:
        kept = pick_first(kept, [subject], random_hex(F.lit(seed), subject, segment), F.col(segment), k=max_windows)
    capped = F.least("n_good", F.lit(max_windows)) if max_windows is not None else F.col("n_good")
    summary = count.select(
        subject, "n_windows", "n_good", (F.col("n_windows") - F.col("n_good")).alias("n_bad"),
        ((F.col("n_windows") - F.col("n_good")) / F.col("n_windows")).alias("bad_fraction"),
        (F.col("n_good") >= min_valid).alias("subject_kept"),
        F.when(F.col("n_good") >= min_valid, capped).otherwise(0).alias("n_kept"))
    return kept, summary


def subject_quality(flags: DataFrame, labels: DataFrame | None = None, subject: str = "subject_id") -> DataFrame:
    """QC05: window counts and percent of artifact windows per subject."""
    bad = F.col("bad_segment_flag").cast("long")
    out = flags.groupBy(subject).agg(
        F.count("*").alias("n_windows"), F.sum(bad).alias("n_artifact"), (100 * F.avg(bad)).alias("pct_artifact"),
        F.avg("max_abs_uv").alias("mean_max_abs_uv"), F.avg("global_std_uv").alias("mean_global_std_uv"))
    return out.join(labels, subject) if labels is not None else out


def class_quality(subjects: DataFrame, label: str = "label_id", value: str = "pct_artifact") -> DataFrame:
    """QC05: mean, sample std, exact median and count of subjects per class."""
    base = subjects.groupBy(label).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n_subjects"))
    return base.join(quantiles(subjects, [label], value, {"median": 0.5}), label)


def extended_metrics(metrics: DataFrame, powers: DataFrame, names: Sequence[str], *, slow: Sequence[str], fast: Sequence[str],
                     posterior: Sequence[str], focus: str, high: str, low: str, keys: Sequence[str] = WKEYS,
                     eps: float = 1e-12) -> DataFrame:
    """SIG10: QC01 plus mean relative band powers, posterior share of one band, slow / fast and high / low ratios.

    ``powers`` holds (keys.., channel, absolute) with one absolute power per entry of ``names``, and
    ``total`` the power of the whole span; ratios use the channel means.
    """
    at = {n: F.element_at("absolute", i + 1) for i, n in enumerate(names)}
    rel = {n: at[n] / (F.col("total") + eps) for n in names}
    post = F.col("channel").isin(list(posterior))
    p = powers.groupBy(*keys).agg(
        *[F.avg(rel[n]).alias(f"rel_{n}_mean") for n in names],
        F.coalesce(F.avg(F.when(post, rel[focus])), F.avg(rel[focus])).alias(f"posterior_{focus}_rel"),
        (F.avg(at[high]) / F.avg(at[low] + eps)).alias("hf_lf_ratio"))
    num, den = F.lit(0.0), F.lit(eps)
    for s in slow:
        num = num + F.col(f"rel_{s}_mean")
    for f in fast:
        den = den + F.col(f"rel_{f}_mean")
    return metrics.join(p.withColumn("slow_fast_ratio", num / den), list(keys))
