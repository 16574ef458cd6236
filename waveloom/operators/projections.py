"""Names, labels, filters, montages, references and normalization of recordings and features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import EPS, c, fixed_map, over, pick_first, random_hex, zscore
from ..functions.fixed import BIPOLAR_PAIRS, CHANNEL_ALIASES, LABEL_ALIASES
from .ordered import attach
from .windows import KEYS, with_length


# ---- names and labels ---------------------------------------------------------------------------

def channel_name(name, rename: dict | None = None) -> Column:
    """PRJ01: clean a channel name and map it to its usual spelling; ``rename`` is applied last."""
    x = F.trim(c(name))
    for pattern in (r"(?i)^EEG\s*", r"\.", r"\s+", r"(?i)-(REF|AVG|AR|LE|RE)$"):
        x = F.regexp_replace(x, pattern, "")
    key = F.upper(x)
    out = F.coalesce(F.try_element_at(fixed_map(CHANNEL_ALIASES), key), x)
    if rename:
        m = fixed_map(rename)
        out = F.coalesce(F.try_element_at(m, out), F.try_element_at(m, key), out)
    return out


def alias_table(spark) -> DataFrame:
    rows = [(d, a, name, i) for d, name, i, aliases in LABEL_ALIASES for a in sorted({*aliases, name.upper(), str(i)})]
    return spark.createDataFrame(rows, "dataset string, alias string, class_name string, class_id int")


def harmonize_labels(df: DataFrame, label: str, dataset, *, unknown: str = "raise", aliases: DataFrame | None = None) -> DataFrame:
    """PRJ02: ids (also as whole-valued decimals) or cleaned spellings to (class_name, class_id) of the data set;
    unknown labels raise, or are kept with id -1."""
    text = F.trim(c(label).cast("string"))
    clean = F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, r"[_\-]+", " "), r"\s+", " ")))
    num = text.try_cast("double")
    key = F.when(num.isNotNull() & (num == F.floor(num)), F.format_string("%d", num.cast("long"))).otherwise(clean)
    a = aliases if aliases is not None else alias_table(df.sparkSession)
    j = df.withColumn("_key", key).withColumn("_ds", F.lower(c(dataset)))
    # the alias table is a constant of a few dozen rows
    j = j.join(F.broadcast(a), (F.col("_key") == F.col("alias")) & (F.col("_ds") == F.col("dataset")), "left")
    name = F.coalesce("class_name", clean if unknown == "keep" else F.raise_error(F.concat(F.lit("unknown label: "), clean)))
    return j.withColumn("class_name", name).withColumn("class_id", F.coalesce("class_id", F.lit(-1))).drop("_key", "_ds", "alias", "dataset")


def split_of(subject_id, *given) -> Column:
    """PRJ18: split from the first given value that is one, else from the id prefix, else Unknown."""
    fold = lambda v: F.when(F.lower(v).isin("train", "training"), "Train").when(
        F.lower(v).isin("val", "valid", "validation"), "Val").when(F.lower(v) == "test", "Test")
    prefix = F.regexp_extract(c(subject_id), r"^(train|training|val|valid|validation|test)_", 1)
    return F.coalesce(*[fold(c(g)) for g in given], fold(prefix), F.lit("Unknown"))


def without_prefix(subject_id) -> Column:
    return F.regexp_replace(c(subject_id), r"^(train|val|validation|test)_", "")


def override_labels(df: DataFrame, official: DataFrame, key: str = "subject_id", names: dict | None = None) -> DataFrame:
    """PRJ19: official labels replace stored ones where present; names fall back to class_<n>."""
    o = official.select(F.col(key), F.col("label").alias("_official"))
    out = df.join(o, key, "left").withColumn("label", F.coalesce("_official", "label")).drop("_official")
    known = F.try_element_at(fixed_map({int(k): v for k, v in (names or {-1: "none"}).items()}), F.col("label").cast("int"))
    return out.withColumn("class_name", F.coalesce(known, F.concat(F.lit("class_"), F.col("label").cast("string"))))


def first_metadata(meta: str, keys: Sequence[str]) -> Column:
    """PRJ14: first present value of alternative metadata keys."""
    return F.coalesce(*[F.try_element_at(c(meta), F.lit(k)) for k in keys])


# ---- row filters --------------------------------------------------------------------------------

def filter_subjects(recordings: DataFrame, *, include: DataFrame | None = None, exclude: DataFrame | None = None,
                    labels: Sequence | None = None, datasets: Sequence[str] | None = None, min_channels: int | None = None,
                    required_channels: Sequence[str] | None = None, has_signal: bool | None = None,
                    predicate: Callable[[DataFrame], Column] | Column | None = None) -> DataFrame:
    """PRJ03: conjunction of the given conditions; ``labels`` match the name or the id."""
    r = recordings
    if include is not None:
        r = r.join(include.select("subject_id").distinct(), "subject_id", "left_semi")
    if exclude is not None:
        r = r.join(exclude.select("subject_id"), "subject_id", "left_anti")
    if labels is not None:
        names = [str(v) for v in labels]
        by = [F.col(k).cast("string").isin(names) for k in ("label", "label_id") if k in r.columns]
        cond = by[0]
        for b in by[1:]:
            cond = cond | b
        r = r.filter(cond)
    if datasets is not None:
        r = r.filter(F.col("dataset_name").isin(list(datasets)))
    if min_channels is not None:
        r = r.filter(F.size("channels") >= min_channels)
    if required_channels is not None:
        r = r.filter(F.size(F.array_except(F.array(*[F.lit(x) for x in required_channels]), F.col("channels"))) == 0)
    if has_signal is not None:
        r = r.filter(F.col("n_samples").isNotNull() if has_signal else F.col("n_samples").isNull())
    if predicate is not None:
        r = r.filter(predicate(r) if callable(predicate) and not isinstance(predicate, Column) else predicate)
    return r


def drop_serials(recordings: DataFrame, bad: DataFrame, *, serial: str = "subject_id", limit: int | None = None,
                 split: str = "split") -> DataFrame:
    """PRJ04: drop listed serials, also where they carry a split prefix; optional number kept per split."""
    r = recordings.withColumn("_serial", without_prefix(F.col(serial).cast("string")))
    r = r.join(bad.select(F.col("serial").cast("string").alias("_serial")), "_serial", "left_anti").drop("_serial")
    return pick_first(r, [split], F.col(serial), k=limit) if limit else r


def keep_good(df: DataFrame, flags: DataFrame, keys: Sequence[str] = ("subject_id", "segment_id"), flag: str = "bad_segment_flag") -> DataFrame:
    """PRJ13: rows of windows that are not flagged; used alike for samples, features and connectivity."""
    return df.join(flags.filter(~F.col(flag).cast("boolean")).select(*keys), list(keys), "left_semi")


def binary_pair(df: DataFrame, pair: tuple, label: str = "label") -> DataFrame:
    """PRJ15: keep two classes and call them 0 and 1."""
    a, b = pair
    if a == b:
        raise ValueError("the two classes must differ")
    return df.filter(F.col(label).isin(a, b)).withColumn("binary_label", F.when(F.col(label) == a, 0).otherwise(1))


# ---- montage and reference ----------------------------------------------------------------------

def drop_channels(df: DataFrame, drop: Sequence[str], channel: str = "channel") -> DataFrame:
    """PRJ05."""
    return df.filter(~F.col(channel).isin(list(drop)))


def bipolar(windows: DataFrame, pairs: Sequence[tuple] = BIPOLAR_PAIRS, keys: Sequence[str] = ("subject_id", "segment_id"),
            channel: str = "channel", x: str = "x") -> DataFrame:
    """PRJ06: first minus second channel for every pair, on window arrays; a missing channel raises."""
    have = windows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(channel, x))).alias("_m"))
    both = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    r = have.select(*keys, "_m", F.posexplode(both).alias("pair_index", "p"))
    va, vb = F.try_element_at("_m", F.col("p.a")), F.try_element_at("_m", F.col("p.b"))
    diff = F.when(va.isNull() | vb.isNull(), F.raise_error(F.concat_ws(" ", F.lit("missing channel of"), "p.a", "p.b"))).otherwise(
        F.zip_with(va, vb, lambda u, v: u - v))
    return r.select(*keys, "pair_index", F.concat_ws("-", "p.a", "p.b").alias(channel), diff.alias(x))


def reference(samples: DataFrame, mode: str = "average", channels: Sequence[str] | None = None,
              custom: Callable[[DataFrame], Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """PRJ07/UDF02: subtract at every time point nothing, the mean of all or of chosen channels, or a custom column.

    The partition is one time point (as many rows as channels), so it stays small.
    """
    if mode == "none":
        return samples
    if mode == "custom":
        return samples.withColumn("value", custom(samples))
    w = over([*keys, "t"])
    ref = F.avg("value").over(w) if mode == "average" else F.avg(F.when(F.col("channel").isin(list(channels or [])), F.col("value"))).over(w)
    return samples.withColumn("value", F.col("value") - ref)


def limit_length(samples: DataFrame, n: int) -> DataFrame:
    """PRJ08: the first ``n`` samples of each channel (a maximum recording length)."""
    return samples.filter(F.col("t") < n)


def trim_trailing_zeros(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """PRJ08: drop the trailing run where every channel is zero; all-zero recordings vanish."""
    last = samples.filter("value <> 0").groupBy(*keys).agg(F.max("t").alias("_last"))
    return samples.join(last, list(keys)).filter("t <= _last").drop("_last")


def to_microvolts(windows: DataFrame, unit: str = "auto", keys: Sequence[str] = ("subject_id", "segment_id"), x: str = "x") -> DataFrame:
    """PRJ12: volts to microvolts; 'auto' takes a window for volts when its largest amplitude is below 1."""
    scaled = F.transform(c(x), lambda v: v * 1e6)
    if unit in ("uv", "microvolt", "microvolts"):
        return windows
    if unit in ("v", "volt", "volts"):
        return windows.withColumn(x, scaled)
    if unit != "auto":
        raise ValueError(f"unknown unit {unit!r}")
    peak = F.max(F.array_max(F.transform(c(x), F.abs))).over(over(list(keys)))
    return windows.withColumn("_peak", peak).withColumn(x, F.when(F.col("_peak") < 1.0, scaled).otherwise(c(x))).drop("_peak")


# ---- normalization ------------------------------------------------------------------------------

def _grouped_z(df: DataFrame, value: str, group: Sequence[str], ddof: int, guard: str, eps: float) -> DataFrame:
    """z-score against per-group moments from a partial aggregate joined back, for groups of any size."""
    sd = (F.stddev_pop if ddof == 0 else F.stddev_samp)(value)
    g = df.groupBy(*group).agg(F.avg(value).alias("_mu"), F.coalesce(sd, F.lit(0.0)).alias("_sd"))
    den = {"one": F.when(F.col("_sd") < eps, 1.0).otherwise(F.col("_sd")), "add": F.col("_sd") + eps,
           "clamp": F.greatest("_sd", F.lit(eps))}[guard]
    j = attach(df, g, list(group))
    return j.withColumn(value, (F.col(value) - F.col("_mu")) / den).drop("_mu", "_sd")


def normalize(df: DataFrame, mode: str, value: str = "value", *, subject: str = "subject_id", eps: float = EPS) -> DataFrame:
    """PRJ09: 'none', 'global' (recording), 'per_channel', 'subject_wise_feature' (subject, feature) or
    'channel_wise_feature' (subject, channel, feature); population std, below eps counted as 1."""
    group = {"none": None, "global": [subject], "per_channel": [subject, "channel"],
             "subject_wise_feature": [subject, "feature"], "channel_wise_feature": [subject, "channel", "feature"]}[mode]
    return df if group is None else _grouped_z(df, value, group, 0, "one", eps)


def normalize_nodes(nodes: DataFrame, value: str = "x", *, graph: str = "graph_id", feature: str = "feature", ddof: int = 0,
                    guard: str = "one", eps: float = EPS) -> DataFrame:
    """PRJ10: z over the nodes of one graph per feature (a graph has tens of nodes)."""
    return nodes.withColumn(value, zscore(value, over([graph, feature]), ddof, eps, guard))


def standardize_subject(df: DataFrame, value: str = "value", keys: Sequence[str] = ("subject_id", "channel", "feature"), eps: float = EPS) -> DataFrame:
    """STA14: z per (subject, channel, feature) with the sample std, at least eps."""
    return _grouped_z(df, value, list(keys), 1, "clamp", eps)


def crop_statistics(samples_of_crops: DataFrame, crop: Sequence[str] = ("subject_id", "segment_id")) -> DataFrame:
    """PRJ11: per channel, the mean over crops of crop means and of crop sample stds."""
    per = samples_of_crops.groupBy(*crop, "channel").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return per.groupBy("channel").agg(F.avg("_m").alias("train_mean"), F.avg("_s").alias("train_std"))


def apply_crop_statistics(df: DataFrame, stats: DataFrame, value: str = "value", eps: float = EPS) -> DataFrame:
    """PRJ11: (x - m) / (s + eps) by channel; the statistics have one row per channel name."""
    return df.join(F.broadcast(stats), "channel").withColumn(value, (F.col(value) - F.col("train_mean")) / (F.col("train_std") + eps))


def add_noise(df: DataFrame, value: str, *, mean: float = 0.0, std: float = 1.0, seed: int = 0, kind: str = "additive",
              key: Sequence[str] = ()) -> DataFrame:
    """PRJ17: x + N or x + x * N. With ``key`` the draw follows the row's key (Box-Muller on two keyed uniforms),
    so it does not change with partitioning; without, ``randn(seed)`` is used."""
    if key:
        from ..functions.exprs import random_unit

        u1, u2 = random_unit(F.lit(seed), F.lit("a"), *key), random_unit(F.lit(seed), F.lit("b"), *key)
        draw = F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * F.pi() * u2)
    else:
        draw = F.randn(seed)
    noise = mean + std * draw
    return df.withColumn(value, c(value) + (noise if kind == "additive" else c(value) * noise))


def add_bias(df: DataFrame, value: str, bias: float) -> DataFrame:
    """PRJ17: constant shift (age bias)."""
    return df.withColumn(value, c(value) + bias)


def limit_per_split(recordings: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    order = [random_hex(F.lit(seed), "subject_id")] if seed is not None else []
    return pick_first(recordings, ["split"], *order, F.col("subject_id"), k=n)
