"""Cutting recordings into windows, grouping windows into longer blocks, and reducing levels.

Samples are long rows (subject_id, channel, t, value); windows are one row per
(subject, window, channel) with the samples in order as an array, so that per-window work needs no
further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, a_sum, c, over, pick_first, random_below, random_hex
from .ordered import attach, positions, quantiles

KEYS = ["subject_id"]


def with_length(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``n``, the number of samples per channel of the recording, unless it is there."""
    if "n" in samples.columns:
        return samples
    return samples.join(samples.groupBy(*keys).agg((F.max("t") + 1).alias("n")), list(keys))


def sliding_windows(samples: DataFrame, *, length: int, step: int, start: int = 0, end: int = 0,
                    keep_partial: bool = False, keys: Sequence[str] = KEYS) -> DataFrame:
    """WIN01/WIN02: fixed sliding windows over t in [start, n - end).

    A sample finds its windows by arithmetic (no range join). ``keep_partial`` adds the shorter last
    window, padded with its last value.
    """
    if length < 1 or step < 1:
        raise ValueError("length and step must be at least one sample")
    s = with_length(samples, keys)
    hi = F.col("n") - end
    s = s.filter((F.col("t") >= start) & (F.col("t") < hi)).withColumn("_o", F.col("t") - start)
    usable = hi - start
    n_full = F.when(usable >= length, F.floor((usable - length) / step) + 1).otherwise(0)
    last_full_end = (n_full - 1) * step + length
    n_win = n_full
    if keep_partial:
        more = ((n_full == 0) | (last_full_end < usable)) & (n_full * step < usable)
        n_win = n_full + F.when(more, 1).otherwise(0)
    first = F.greatest(F.lit(0), F.ceil((F.col("_o") - (length - 1)) / step))
    last = F.least(F.floor(F.col("_o") / step), n_win - 1)
    s = s.withColumn("_f", first).withColumn("_l", last).filter("_f <= _l")
    s = s.withColumn("segment_id", F.explode(F.sequence("_f", "_l")))
    w = s.groupBy(*keys, "segment_id", "channel").agg(
        F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_s"), F.max("n").alias("n"))
    x = F.col("_s.value")
    if keep_partial:
        x = F.when(F.size(x) < length, F.concat(x, F.array_repeat(F.element_at(x, -1), length - F.size(x)))).otherwise(x)
    begin = F.lit(start) + F.col("segment_id") * step
    return w.select(*keys, "segment_id", "channel", begin.cast("long").alias("start_sample"),
                    F.least(begin + length, F.col("n") - end).cast("long").alias("end_sample"), x.alias("x"))


def segment_signal(samples: DataFrame, sfreq: float, *, window_sec: float, overlap: float = 0.0,
                   start_offset_sec: float = 0.0, end_offset_sec: float = 0.0, keep_partial: bool = False,
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """WIN01 in seconds: sizes are rounded to samples, and begin and end are also given in seconds."""
    if not 0.0 <= overlap < 1.0:
        raise ValueError("overlap must be in [0, 1)")
    length = round(window_sec * sfreq)
    w = sliding_windows(samples, length=length, step=round(length * (1 - overlap)),
                        start=round(start_offset_sec * sfreq), end=round(end_offset_sec * sfreq),
                        keep_partial=keep_partial, keys=keys)
    return w.withColumn("start_sec", F.col("start_sample") / sfreq).withColumn("end_sec", F.col("end_sample") / sfreq)


def random_crops(recordings: DataFrame, *, length: int, count, seed: int, latency: int = 0, snap: int | None = None,
                 id_cols: Sequence[str] = ("split", "subject_id"), n: str = "n_samples") -> DataFrame:
    """WIN03: ``count`` seeded starts per recording, uniform in [latency, n - length); optionally snapped to a grid."""
    room = F.col(n) - length - latency
    r = recordings.filter(room > 0).withColumn("crop", F.explode(F.sequence(F.lit(1), c(count).cast("int") if not isinstance(count, int) else F.lit(count))))
    start = F.lit(latency) + random_below(room, F.lit(seed), *id_cols, "crop")
    if snap:
        start = F.lit(latency) + F.floor((start - latency) / snap) * snap
    return r.withColumn("start_sample", start.cast("long")).withColumn("end_sample", (start + length).cast("long"))


def crops_per_recording(recordings: DataFrame, target: int) -> DataFrame:
    """WIN14: balanced allocation, ceil(target / recordings) each, with the total that results."""
    per = F.ceil(F.lit(target) / F.col("n_records")).cast("long")
    return recordings.agg(F.count("*").alias("n_records")).select(
        "n_records", per.alias("crops_per_record"), (per * F.col("n_records")).alias("total_crops"))


def event_crops(markers: DataFrame, lengths: DataFrame, *, event: str, before: int, after: int, jitter: int = 0,
                seed: int = 0, pick: str = "all") -> DataFrame:
    """WIN04: [t - before, t + after) around an event, shifted by a seeded jitter; crops that do not fit are dropped.

    ``pick``: 'all', 'first' or 'random' event per recording.
    """
    m = markers.filter(F.lower("name") == event.lower()).join(lengths, "subject_id")
    shift = random_below(F.lit(2 * jitter + 1), F.lit(seed), "subject_id", "sample") - jitter if jitter else F.lit(0)
    m = m.withColumn("start_sample", F.col("sample") - before + shift).withColumn("end_sample", F.col("sample") + after + shift)
    m = m.filter((F.col("start_sample") >= 0) & (F.col("end_sample") <= F.col("n_samples")))
    if pick == "first":
        m = pick_first(m, ["subject_id"], F.col("sample"))
    elif pick == "random":
        m = pick_first(m, ["subject_id"], random_hex(F.lit(seed), "subject_id", "sample"), F.col("sample"))
    return m


def closed_intervals(markers: DataFrame, *, closed: str = "eyes closed", opened: str = "eyes open",
                     transition: int = 0, length: int = 0, jitter: int = 0) -> DataFrame:
    """WIN05: intervals from a 'closed' marker to the next 'open'; a repeated 'closed' restarts, a trailing one is dropped.

    Only the last 'closed' of a run opens an interval, which is the one whose next marker is an 'open'.
    The next marker is found by an equi join on the marker's place in its recording, so a recording
    with very many markers is not gathered in one task.
    """
    m = markers.filter(F.lower("name").isin(closed, opened))
    at = positions(m.select("subject_id", "sample", F.lower("name").alias("name")), ["subject_id"], ["sample", "name"], "_at")
    nxt = at.select("subject_id", (F.col("_at") - 1).alias("_at"), F.col("sample").alias("end_sample"), F.col("name").alias("_next"))
    iv = at.join(nxt, ["subject_id", "_at"]).filter((F.col("name") == closed) & (F.col("_next") == opened))
    return iv.filter(F.col("end_sample") - F.col("sample") >= transition + length + jitter).select(
        "subject_id", (F.col("sample") + transition).alias("start_sample"), "end_sample")


def cut_intervals(samples: DataFrame, intervals: DataFrame, *, block: int = 4096) -> DataFrame:
    """Samples inside intervals, as an equi join on (subject, block of samples) plus an exact filter."""
    iv = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_sample") / block),
                                                         F.floor((F.col("end_sample") - 1) / block))))
    s = samples.withColumn("_b", F.floor(F.col("t") / block))
    return s.join(iv, ["subject_id", "_b"]).filter("t >= start_sample AND t < end_sample").drop("_b")


def middle_extract(samples: DataFrame, length: int, strategy: str = "center", keys: Sequence[str] = KEYS) -> DataFrame:
    """WIN06: the centre (or first) ``length`` samples of a recording; shorter ones are kept whole."""
    s = with_length(samples, keys)
    start = F.lit(0) if strategy == "first" else F.greatest(F.floor((F.col("n") - length) / 2), F.lit(0))
    return s.filter((F.col("t") >= start) & (F.col("t") < start + length)).withColumn("t_out", F.col("t") - start)


def macro_groups(windows: DataFrame, *, duration: int, step: int | None = None, rule: str = "center",
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """WIN07 (rule 'center') and WIN08 (rule 'start'): fixed-duration blocks of windows.

    Positions are counted inside (recording, block), which a block's duration bounds.
    """
    step = step or duration
    at = F.floor((F.col("start_sample") + F.col("end_sample")) / 2) if rule == "center" else F.col("start_sample")
    m = windows.withColumn("macro_id", F.floor(at / step).cast("long"))
    g = [*keys, "macro_id"]
    return (m.withColumn("macro_start_sample", F.col("macro_id") * step)
            .withColumn("macro_end_sample", F.col("macro_id") * step + duration)
            .withColumn("window_index_in_macro", (F.row_number().over(over(g, "segment_id")) - 1).cast("long"))
            .withColumn("num_windows_in_macro", F.count("*").over(over(g))))


def macro_by_count(windows: DataFrame, windows_per_macro: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """WIN09: every ``windows_per_macro`` consecutive windows."""
    at = positions(windows, keys, ["segment_id"], "_at")
    return at.withColumn("macro_id", F.floor(F.col("_at") / windows_per_macro).cast("long")).drop("_at")


def reducer(how: str, value) -> Column:
    """Aggregate by name; 'median' averages the two middle values, 'median_low' takes the lower one."""
    v = c(value)
    return {"mean": F.avg, "std": F.stddev_pop, "max": F.max, "min": F.min, "sum": F.sum,
            "median": lambda x: F.percentile(x, F.lit(0.5)),
            "median_low": lambda x: F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _reduce_in)")}[how](v)


def to_level(df: DataFrame, group: Sequence[str], value: str, how: str = "mean", label: str | None = None) -> DataFrame:
    """WIN10: reduce rows of windows to a longer level; with ``label`` the label must be the same in a group."""
    aggs = [reducer(how, "_reduce_in").alias(value), F.count("*").alias("n_windows")]
    if label:
        same = F.min(label) == F.max(label)
        aggs.append(F.when(same, F.min(label)).otherwise(F.raise_error(F.lit("mixed labels in a group"))).alias(label))
    if how == "median":  # exact and spread, for levels as long as a subject
        out = df.groupBy(*group).agg(*aggs[1:])
        return attach(out, quantiles(df, list(group), value, {value: 0.5}), list(group))
    return df.withColumn("_reduce_in", F.col(value)).groupBy(*group).agg(*aggs)


def weighted_mean(df: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """WIN11: mean over windows weighted by ``weight``, normalized by the sum of weights (at least 1e-8)."""
    return df.groupBy(*group).agg(
        (F.sum(F.col(weight) * F.col(value)) / F.greatest(F.sum(weight), F.lit(EPS))).alias(value))


def macro_report(macros: DataFrame, sfreq: float, keys: Sequence[str] = ("split", "label", "subject_id")) -> tuple[DataFrame, DataFrame]:
    """WIN12: per recording the segments per block and its duration; per (split, label) mean, std, min, max."""
    by_macro = macros.groupBy(*keys, "macro_id").agg(
        F.count("*").alias("n_segments"), F.min("start_sample").alias("lo"), F.max("end_sample").alias("hi"))
    subject = by_macro.groupBy(*keys).agg(
        F.count("*").alias("n_macros"), F.sum("n_segments").alias("n_segments"),
        F.avg("n_segments").alias("mean_segments_per_macro"),
        ((F.max("hi") - F.min("lo")) / sfreq).alias("duration_sec"))
    stats = [f(m).alias(f"{n}_{m}") for m in ("n_macros", "mean_segments_per_macro", "duration_sec")
             for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return subject, subject.groupBy(*[k for k in keys if k != "subject_id"]).agg(F.count("*").alias("n_subjects"), *stats)
