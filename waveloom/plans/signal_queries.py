"""Queries for projections (PRJ), windows (WIN), signal features (SIG) and window quality (QC01-QC05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import DB4_LOWPASS
from ..operators import features as ft
from ..operators import projections as prj
from ..operators import quality as qc
from ..operators import recordings as rec
from ..operators import windows as win
from .registry import query
from .views import BANDS8, FS

WCH = "subject_id, segment_id, channel"

# ---------------------------------------------------------------------------------------- names, labels

_NAMES = ["fp1", "FZ.", "Cz", "m1", "ecg", "Oz ", "T 3", "x9"]
_PARTS_SQL = ("SELECT p_partkey, 'EEG ' || list_extract(['fp1', 'FZ.', 'Cz', 'm1', 'ecg', 'Oz ', 'T 3', 'x9'], "
              "CAST(p_partkey % 8 + 1 AS INTEGER)) || list_extract(['-REF', '-avg', ''], CAST(p_partkey % 3 + 1 AS INTEGER)) AS raw FROM part")


def _raw_names(t):
    names = F.array(*[F.lit(n) for n in _NAMES])
    ends = F.array(F.lit("-REF"), F.lit("-avg"), F.lit(""))
    return t.table("part").select("p_partkey", F.concat(
        F.lit("EEG "), F.element_at(names, (F.col("p_partkey") % 8 + 1).cast("int")),
        F.element_at(ends, (F.col("p_partkey") % 3 + 1).cast("int"))).alias("raw"))


@query("prj01_channel_names", "p_partkey:i raw:s name:s", f"""
    SELECT p_partkey, raw, CASE upper(k) WHEN 'FP1' THEN 'Fp1' WHEN 'FZ' THEN 'Midline' WHEN 'CZ' THEN 'Cz' WHEN 'M1' THEN 'A1'
      WHEN 'ECG' THEN 'EKG' WHEN 'OZ' THEN 'Oz' WHEN 'T3' THEN 'T3' ELSE k END AS name
    FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(raw, '^EEG\\s*', ''), '[.\\s]', '', 'g'),
                  '-(REF|AVG|AR|LE|RE)$', '', 'i') AS k FROM ({_PARTS_SQL}))""")
def _(t):
    return _raw_names(t).withColumn("name", prj.channel_name("raw", {"Fz": "Midline"}))


@query("prj02_harmonize_labels", "c_custkey:i raw:s class_name:s class_id:i", """
    SELECT c_custkey, raw,
      CASE WHEN k IN ('HEALTHY', '0', 'NORMAL') THEN 'Healthy' WHEN k IN ('ALZHEIMER', '1', 'DEMENTIA') THEN 'Dementia'
           WHEN k IN ('MILD COGNITIVE IMPAIRMENT', '2') THEN 'MCI' ELSE k END AS class_name,
      CASE WHEN k IN ('HEALTHY', '0', 'NORMAL') THEN 0 WHEN k IN ('ALZHEIMER', '1', 'DEMENTIA') THEN 1
           WHEN k IN ('MILD COGNITIVE IMPAIRMENT', '2') THEN 2 ELSE -1 END AS class_id
    FROM (SELECT *, CASE WHEN raw IN ('1.0', '2') THEN raw[1] ELSE upper(trim(regexp_replace(raw, '[_\\-\\s]+', ' ', 'g'))) END AS k
      FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'healthy' WHEN 'MACHINERY' THEN 'mild_cognitive--impairment'
              WHEN 'AUTOMOBILE' THEN ' Alzheimer ' WHEN 'HOUSEHOLD' THEN CASE WHEN c_nationkey % 2 = 0 THEN '1.0' ELSE '2' END
              ELSE lower(c_mktsegment) END AS raw FROM customer))""")
def _(t):
    seg = F.col("c_mktsegment")
    raw = (F.when(seg == "BUILDING", "healthy").when(seg == "MACHINERY", "mild_cognitive--impairment")
           .when(seg == "AUTOMOBILE", " Alzheimer ")
           .when(seg == "HOUSEHOLD", F.when(F.col("c_nationkey") % 2 == 0, "1.0").otherwise("2")).otherwise(F.lower(seg)))
    c = t.table("customer").select("c_custkey", raw.alias("raw"))
    return prj.harmonize_labels(c, "raw", F.lit("CAUEEG"), unknown="keep")


@query("prj03_filter_subjects", "subject_id:i n_channels:i", """
    WITH r AS (SELECT user_id AS subject_id, list(DISTINCT event_type) AS ch FROM events GROUP BY 1)
    SELECT subject_id, len(ch) AS n_channels FROM r
    WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND subject_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 1000)
      AND subject_id % 3 IN (0, 2) AND len(ch) >= 3 AND list_contains(ch, 'click') AND list_contains(ch, 'error')""")
def _(t):
    r = (t.table("events").groupBy(F.col("user_id").alias("subject_id")).agg(F.collect_set("event_type").alias("channels"))
         .withColumn("label_id", F.col("subject_id") % 3))
    inc = t.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("subject_id"))
    exc = t.table("supplier").filter("s_acctbal < 1000").select(F.col("s_suppkey").alias("subject_id"))
    return prj.filter_subjects(r, include=inc, exclude=exc, labels=[0, "2"], min_channels=3,
                               required_channels=["click", "error"]).withColumn("n_channels", F.size("channels"))


@query("prj04_bad_serials", "subject_id:s split:s", """
    SELECT split || '_' || c_custkey AS subject_id, split FROM (
      SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM customer
      WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000))""")
def _(t):
    split = F.when(F.col("c_custkey") % 5 == 0, "test").when(F.col("c_custkey") % 5 == 1, "val").otherwise("train")
    c = t.table("customer").select(split.alias("split"), F.concat_ws("_", split, "c_custkey").alias("subject_id"))
    bad = t.table("supplier").filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("serial"))
    return prj.drop_serials(c, bad)


@query("prj05_drop_channels", "subject_id:i channel:s t:i value:d",
       "SELECT * FROM v_samples WHERE channel NOT IN ('signup', 'view')")
def _(t):
    return prj.drop_channels(t.samples, ["signup", "view"])


_PAIRS = [("click", "error"), ("error", "view"), ("purchase", "signup")]


@query("prj06_bipolar", "subject_id:i segment_id:i channel:s k:i value:d", """
    SELECT a.subject_id, a.segment_id, p.a || '-' || p.b AS channel, a.k, a.value - b.value AS value
    FROM (VALUES ('click', 'error'), ('error', 'view'), ('purchase', 'signup')) p(a, b)
    JOIN v_windows a ON a.channel = p.a JOIN v_windows b ON b.channel = p.b
      AND a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.k = b.k""")
def _(t):
    return prj.bipolar(t.windows, _PAIRS).select("subject_id", "segment_id", "channel", F.posexplode_outer("x").alias("k", "value"))


@query("prj07_reference", "subject_id:i channel:s t:i average:d chosen:d", """
    SELECT subject_id, channel, t, value - avg(value) OVER w AS average,
           value - avg(CASE WHEN channel IN ('click', 'view') THEN value END) OVER w AS chosen
    FROM v_samples WINDOW w AS (PARTITION BY subject_id, t)""")
def _(t):
    s = t.samples.select("subject_id", "channel", "t", "value", F.col("value").alias("raw"))
    a = prj.reference(s, "average").withColumnRenamed("value", "average").withColumnRenamed("raw", "value")
    return prj.reference(a, "chosen", ["click", "view"]).withColumnRenamed("value", "chosen")


@query("prj08_trim", "subject_id:i channel:s t:i value:d", """
    WITH z AS (SELECT subject_id, channel, t, n, CASE WHEN t > n - 1 - subject_id % 4 THEN 0 ELSE value END AS value FROM v_samples)
    SELECT z.* FROM z JOIN (SELECT subject_id, max(t) AS last FROM z WHERE value <> 0 GROUP BY 1) l USING (subject_id)
    WHERE t <= last AND t < 1000000""")
def _(t):
    z = t.samples.withColumn("value", F.when(F.col("t") > F.col("n") - 1 - F.col("subject_id") % 4, 0.0).otherwise(F.col("value")))
    return prj.limit_length(prj.trim_trailing_zeros(z), 1_000_000)


def _z_sql(part):
    return (f"(value - avg(value) OVER (PARTITION BY {part})) / CASE WHEN stddev_pop(value) OVER (PARTITION BY {part}) < 1e-8 THEN 1 "
            f"ELSE stddev_pop(value) OVER (PARTITION BY {part}) END")


@query("prj09_normalize", "subject_id:i channel:s t:i per_channel:d whole:d",
       f"SELECT subject_id, channel, t, {_z_sql('subject_id, channel')} AS per_channel, {_z_sql('subject_id')} AS whole FROM v_samples")
def _(t):
    s = t.samples.withColumn("per_channel", F.col("value")).withColumn("whole", F.col("value"))
    return prj.normalize(prj.normalize(s, "per_channel", "per_channel"), "global", "whole")


@query("prj09_feature_modes", "graph_id:i channel:i feature:i subject_wise:d channel_wise:d", f"""
    SELECT graph_id, node AS channel, feature, {_z_sql('subject_id, feature')} AS subject_wise, {_z_sql('subject_id, node, feature')} AS channel_wise
    FROM (SELECT *, x AS value FROM v_nodes)""")
def _(t):
    n = t.nodes.select("graph_id", "subject_id", F.col("node").alias("channel"), "feature", F.col("x").alias("subject_wise"), F.col("x").alias("channel_wise"))
    return prj.normalize(prj.normalize(n, "subject_wise_feature", "subject_wise"), "channel_wise_feature", "channel_wise")


@query("prj10_node_zscore", "graph_id:i node:i feature:i one:d added:d sample:d", f"""
    SELECT graph_id, node, feature, {_z_sql('graph_id, feature')} AS one,
      (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8) AS added,
      (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8) AS sample
    FROM (SELECT *, x AS value FROM v_nodes) WINDOW w AS (PARTITION BY graph_id, feature)""")
def _(t):
    n = t.nodes.select("graph_id", "node", "feature", F.col("x").alias("one"), F.col("x").alias("added"), F.col("x").alias("sample"))
    n = prj.normalize_nodes(n, "one")
    n = prj.normalize_nodes(n, "added", guard="add")
    return prj.normalize_nodes(n, "sample", ddof=1, guard="add")


@query("prj11_crop_normalize", "subject_id:i channel:s t:i value:d", """
    WITH s AS (SELECT channel, avg(m) AS tm, avg(s) AS ts FROM (
        SELECT subject_id, segment_id, channel, avg(value) AS m, stddev_samp(value) AS s FROM v_windows WHERE subject_id % 5 > 1 GROUP BY ALL) GROUP BY 1)
    SELECT v.subject_id, v.channel, v.t, (v.value - tm) / (ts + 1e-8) AS value FROM v_samples v JOIN s USING (channel)""")
def _(t):
    train = t.windows.filter("subject_id % 5 > 1").select("subject_id", "segment_id", "channel", F.explode("x").alias("value"))
    return prj.apply_crop_statistics(t.samples, prj.crop_statistics(train))


@query("prj12_microvolts", "subject_id:i segment_id:i channel:s k:i value:d4", """
    SELECT subject_id, segment_id, channel, k, CASE WHEN max(abs(v)) OVER (PARTITION BY subject_id, segment_id) < 1 THEN v * 1e6 ELSE v END AS value
    FROM (SELECT *, value / 100 AS v FROM v_windows)""")
def _(t):
    w = t.windows.withColumn("x", F.transform("x", lambda v: v / 100))
    return prj.to_microvolts(w).select("subject_id", "segment_id", "channel", F.posexplode_outer("x").alias("k", "value"))


_FLAGGED_SQL = "SELECT subject_id, segment_id, max(abs(value)) > 150 AS bad FROM v_windows GROUP BY 1, 2"


@query("prj13_good_windows", "subject_id:i segment_id:i channel:s mean:d", f"""
    SELECT subject_id, segment_id, channel, avg(value) AS mean FROM v_windows
    SEMI JOIN (SELECT * FROM ({_FLAGGED_SQL}) WHERE NOT bad) USING (subject_id, segment_id) GROUP BY ALL""")
def _(t):
    peak = F.array_max(F.transform("x", F.abs))
    flags = t.windows.groupBy("subject_id", "segment_id").agg((F.max(peak) > 150).alias("bad_segment_flag"))
    feats = ft.time_stats(t.windows)
    return prj.keep_good(feats, flags)


@query("prj14_metadata", "event_id:i age:i", """
    SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS age FROM events""")
def _(t):
    m = t.table("events").select("event_id", F.from_json("props", "map<string,bigint>").alias("meta"))
    return m.select("event_id", F.coalesce(prj.first_metadata("meta", ["age", "Age", "k"]), F.lit(-1)).alias("age"))


@query("prj15_binary_pair", "instance_id:i binary_label:i",
       "SELECT instance_id, CASE WHEN true_label = 0 THEN 0 ELSE 1 END AS binary_label FROM v_preds WHERE true_label IN (0, 2)")
def _(t):
    return prj.binary_pair(t.preds, (0, 2), "true_label")


@query("prj16_feature_names", "channel:s ord:i family:s feature:s n:i", """
    SELECT channel, ord, family, feature, n FROM (SELECT event_type AS channel, count(*) AS n FROM events GROUP BY 1),
      (VALUES (0, 'rbp', 'rbp_low'), (1, 'rbp', 'rbp_mid'), (2, 'rbp', 'rbp_high'), (3, 'hjorth', 'hjorth_activity'), (4, 'hjorth', 'hjorth_mobility'),
        (5, 'hjorth', 'hjorth_complexity'), (6, 'energies', 'energy_d1'), (7, 'energies', 'energy_d2'), (8, 'energies', 'energy_d3'),
        (9, 'energies', 'energy_d4'), (10, 'energies', 'energy_d5'), (11, 'energies', 'energy_a5'), (12, 'hfd', 'hfd')) f(ord, family, feature)""")
def _(t):
    names = ft.expanded_names(["rbp", "hjorth", "energies", "hfd"], list(BANDS8))
    arr = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("feature")) for f, n in names])
    ch = t.table("events").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    return ch.select("channel", "n", F.posexplode(arr).alias("ord", "f")).select("channel", "n", "ord", "f.family", "f.feature")


@query("prj17_noise", "subject_id:i channel:s t:i noisy:d scaled:d shifted:d", """
    WITH u AS (SELECT *, concat_ws('|', subject_id, channel, t) AS key FROM v_samples),
    d AS (SELECT *, sqrt(-2 * ln(1 - CAST('0x' || substr(md5('3|a|' || key), 1, 13) AS BIGINT) / 4503599627370496.0))
      * cos(2 * pi() * (CAST('0x' || substr(md5('3|b|' || key), 1, 13) AS BIGINT) / 4503599627370496.0)) AS z FROM u)
    SELECT subject_id, channel, t, value + 1 + 0.5 * z AS noisy, value + value * (0.1 * z) AS scaled, value + 2 AS shifted FROM d""")
def _(t):
    key = ["subject_id", "channel", "t"]
    s = t.samples.select(*key, *[F.col("value").alias(n) for n in ("noisy", "scaled", "shifted")])
    s = prj.add_noise(s, "noisy", mean=1.0, std=0.5, seed=3, key=key)
    s = prj.add_noise(s, "scaled", std=0.1, seed=3, kind="scaled", key=key)
    return prj.add_bias(s, "shifted", 2.0)


@query("prj18_split_names", "id:s split:s", """
    SELECT id, CASE WHEN given IN ('training') THEN 'Train' WHEN id LIKE 'val_%' THEN 'Val' WHEN id LIKE 'test_%' THEN 'Test'
      WHEN id LIKE 'train_%' THEN 'Train' ELSE 'Unknown' END AS split
    FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'test_' WHEN 1 THEN 'val_' WHEN 2 THEN '' ELSE 'train_' END || c_custkey AS id,
                 CASE WHEN c_custkey % 10 = 2 THEN 'training' END AS given FROM customer)""")
def _(t):
    k = F.col("c_custkey")
    pre = F.when(k % 5 == 0, "test_").when(k % 5 == 1, "val_").when(k % 5 == 2, "").otherwise("train_")
    c = t.table("customer").select(F.concat(pre, k).alias("id"), F.when(k % 10 == 2, "training").alias("given"))
    return c.withColumn("split", prj.split_of("id", "given"))


@query("prj19_label_override", "instance_id:i label:i class_name:s", """
    SELECT instance_id, coalesce(c_nationkey % 4, true_label) AS label,
      CASE coalesce(c_nationkey % 4, true_label) WHEN 0 THEN 'Healthy' WHEN 1 THEN 'Dementia' WHEN 2 THEN 'MCI' ELSE 'class_3' END AS class_name
    FROM v_preds LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON c_custkey = subject_id""")
def _(t):
    off = t.table("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("subject_id"), (F.col("c_nationkey") % 4).cast("long").alias("label"))
    p = t.preds.select("subject_id", "instance_id", F.col("true_label").alias("label"))
    return prj.override_labels(p, off, names={0: "Healthy", 1: "Dementia", 2: "MCI"})


# ---------------------------------------------------------------------------------------- windows

@query("win01_sliding", "subject_id:i segment_id:i channel:s start_sample:i end_sample:i start_sec:d end_sec:d num_samples:i total:d", """
    SELECT subject_id, segment_id, channel, min(start_sample) AS start_sample, min(end_sample) AS end_sample,
      min(start_sample) / 8 AS start_sec, min(end_sample) / 8 AS end_sec, count(*) AS num_samples, sum(value) AS total
    FROM v_windows GROUP BY 1, 2, 3""")
def _(t):
    w = win.segment_signal(t.samples, FS, window_sec=1.0, overlap=0.5)
    return w.withColumn("num_samples", F.size("x")).withColumn("total", F.aggregate("x", F.lit(0.0), lambda s, v: s + v))


@query("win01_keep_partial", "subject_id:i segment_id:i channel:s start_sample:i end_sample:i n:i total:d", """
    WITH r AS (SELECT subject_id, channel, n, list(value ORDER BY t) AS v FROM v_samples GROUP BY 1, 2, 3),
    w AS (SELECT *, unnest(range(0, CASE WHEN n - 5 >= 8 THEN (n - 5 - 8) // 5 + 2 ELSE 1 END)) AS segment_id FROM r)
    SELECT subject_id, segment_id, channel, s AS start_sample, e AS end_sample, 8 AS n,
      list_sum(v[s + 1:e]) + (8 - (e - s)) * v[e] AS total
    FROM (SELECT *, 3 + segment_id * 5 AS s, least(3 + segment_id * 5 + 8, n - 2) AS e FROM w)
    WHERE e > s AND (segment_id = 0 OR 3 + (segment_id - 1) * 5 + 8 < n - 2)""")
def _(t):
    w = win.sliding_windows(t.samples, length=8, step=5, start=3, end=2, keep_partial=True)
    return w.withColumn("n", F.size("x")).withColumn("total", F.aggregate("x", F.lit(0.0), lambda s, v: s + v))


@query("win02_latency", "subject_id:i segment_id:i channel:s start_sample:i total:d", """
    SELECT subject_id, w.segment_id, channel, 6 + 4 * w.segment_id AS start_sample, sum(value) AS total
    FROM v_samples s, LATERAL (SELECT unnest(range(0, (n - 6) // 4)) AS segment_id) w
    WHERE t >= 6 + 4 * w.segment_id AND t < 10 + 4 * w.segment_id GROUP BY ALL""")
def _(t):
    w = win.sliding_windows(t.samples, length=4, step=4, start=6)
    return w.withColumn("total", F.aggregate("x", F.lit(0.0), lambda s, v: s + v))


@query("win03_random_crops", "subject_id:i crop:i start_sample:i end_sample:i", """
    SELECT subject_id, crop, start_sample, start_sample + 4 AS end_sample FROM (
      SELECT subject_id, crop, 1 + CAST(floor(CAST('0x' || substr(md5(concat_ws('|', 7, split, subject_id, crop)), 1, 13) AS BIGINT)
        / 4503599627370496.0 * (n - 5)) AS BIGINT) AS start_sample
      FROM (SELECT DISTINCT subject_id, n, CASE subject_id % 3 WHEN 0 THEN 'train' ELSE 'val' END AS split FROM v_samples), range(1, 6) r(crop) WHERE n > 5)""")
def _(t):
    r = t.recordings.withColumn("split", F.when(F.col("subject_id") % 3 == 0, "train").otherwise("val"))
    return win.random_crops(r, length=4, count=5, seed=7, latency=1)


@query("win04_eye_open_crop", "subject_id:i sample:i start_sample:i end_sample:i", """
    WITH n AS (SELECT subject_id, count(*) AS n FROM v_markers GROUP BY 1),
    m AS (SELECT subject_id, sample, n, CAST(floor(CAST('0x' || substr(md5(concat_ws('|', 5, subject_id, sample)), 1, 13) AS BIGINT)
        / 4503599627370496.0 * 3) AS BIGINT) - 1 AS j FROM v_markers JOIN n USING (subject_id) WHERE name = 'eyes open')
    SELECT subject_id, sample, sample - 3 + j AS start_sample, sample + 4 + j AS end_sample FROM m WHERE sample - 3 + j >= 0 AND sample + 4 + j <= n""")
def _(t):
    n = t.markers.groupBy("subject_id").agg(F.count("*").alias("n_samples"))
    return win.event_crops(t.markers, n, event="Eyes Open", before=3, after=4, jitter=1, seed=5)


@query("win04_first_crop", "subject_id:i sample:i start_sample:i end_sample:i", """
    SELECT subject_id, min(sample) AS sample, min(sample) - 3 AS start_sample, min(sample) + 4 AS end_sample
    FROM v_markers JOIN (SELECT subject_id, count(*) AS n FROM v_markers GROUP BY 1) USING (subject_id)
    WHERE name = 'eyes open' AND sample >= 3 AND sample + 4 <= n GROUP BY 1""")
def _(t):
    n = t.markers.groupBy("subject_id").agg(F.count("*").alias("n_samples"))
    return win.event_crops(t.markers, n, event="eyes open", before=3, after=4, pick="first")


@query("win05_eye_closed_intervals", "subject_id:i start_sample:i end_sample:i", """
    SELECT subject_id, sample AS start_sample, nxt AS end_sample FROM (
      SELECT *, lead(sample) OVER w AS nxt, lead(name) OVER w AS nn FROM v_markers WINDOW w AS (PARTITION BY subject_id ORDER BY sample))
    WHERE name = 'eyes closed' AND nn = 'eyes open' AND nxt - sample >= 1""")
def _(t):
    return win.closed_intervals(t.markers, length=1)


@query("win05_closed_samples", "subject_id:i start_sample:i end_sample:i n:i total:d", """
    WITH m AS (SELECT subject_id, t AS sample, CASE WHEN value > 0 THEN 'eyes open' ELSE 'eyes closed' END AS name FROM v_samples WHERE channel = 'click'),
    iv AS (SELECT subject_id, sample AS start_sample, nxt AS end_sample FROM (
      SELECT *, lead(sample) OVER w AS nxt, lead(name) OVER w AS nn FROM m WINDOW w AS (PARTITION BY subject_id ORDER BY sample))
      WHERE name = 'eyes closed' AND nn = 'eyes open')
    SELECT s.subject_id, start_sample, end_sample, count(*) AS n, sum(value) AS total FROM v_samples s JOIN iv
      ON s.subject_id = iv.subject_id AND s.t >= start_sample AND s.t < end_sample GROUP BY ALL""")
def _(t):
    m = t.samples.filter("channel = 'click'").select("subject_id", F.col("t").alias("sample"),
                                                     F.when(F.col("value") > 0, "eyes open").otherwise("eyes closed").alias("name"))
    cut = win.cut_intervals(t.samples, win.closed_intervals(m), block=16)
    return cut.groupBy("subject_id", "start_sample", "end_sample").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("win06_center_extract", "subject_id:i channel:s t:i t_out:i value:d", """
    SELECT subject_id, channel, t, t - s AS t_out, value FROM (SELECT *, greatest((n - 20) // 2, 0) AS s FROM v_samples) WHERE t >= s AND t < s + 20""")
def _(t):
    return win.middle_extract(t.samples, 20)


_MACRO = "subject_id:i segment_id:i macro_id:i macro_start_sample:i macro_end_sample:i window_index_in_macro:i num_windows_in_macro:i"


def _macro_sql(at):
    return f"""SELECT subject_id, segment_id, macro_id, macro_id * 20 AS macro_start_sample, macro_id * 20 + 20 AS macro_end_sample,
      row_number() OVER (PARTITION BY subject_id, macro_id ORDER BY segment_id) - 1 AS window_index_in_macro,
      count(*) OVER (PARTITION BY subject_id, macro_id) AS num_windows_in_macro FROM (SELECT *, {at} // 20 AS macro_id FROM v_windex)"""


@query("win07_macro_center", _MACRO, _macro_sql("((start_sample + end_sample) // 2)"))
def _(t):
    return win.macro_groups(t.window_index, duration=20)


@query("win08_macro_start", _MACRO, _macro_sql("start_sample"))
def _(t):
    return win.macro_groups(t.window_index, duration=20, rule="start")


@query("win09_macro_count", "subject_id:i segment_id:i macro_id:i", """
    SELECT subject_id, segment_id, (row_number() OVER (PARTITION BY subject_id ORDER BY segment_id) - 1) // 10 AS macro_id FROM v_windex""")
def _(t):
    return win.macro_by_count(t.window_index)


_LEVEL_GROUP = ["subject_id", "macro_id", "i", "j"]


@query("win10_level_conversion", "subject_id:i macro_id:i i:i j:i label:i n_windows:i mean:d median:d median_low:d std:d hi:d", """
    SELECT subject_id, segment_id * 500 // 2000 AS macro_id, i, j, min(label) AS label, count(*) AS n_windows, avg(w) AS mean,
      quantile_cont(w, 0.5) AS median, quantile_disc(w, 0.5) AS median_low, stddev_pop(w) AS std, max(w) AS hi
    FROM v_edges GROUP BY 1, 2, 3, 4""")
def _(t):
    e = t.edges.withColumn("macro_id", F.floor(F.col("segment_id") * 500 / 2000)).withColumn("_reduce_in", F.col("w"))
    return e.groupBy(*_LEVEL_GROUP).agg(F.min("label").alias("label"), F.count("*").alias("n_windows"), *[
        win.reducer(h, "_reduce_in").alias(n) for h, n in
        (("mean", "mean"), ("median", "median"), ("median_low", "median_low"), ("std", "std"), ("max", "hi"))])


@query("win10_label_check", "subject_id:i node:i feature:i label:i n_windows:i x:d", """
    SELECT subject_id, node, feature, min(label) AS label, count(*) AS n_windows, avg(x) AS x FROM v_nodes GROUP BY 1, 2, 3""")
def _(t):
    return win.to_level(t.nodes, ["subject_id", "node", "feature"], "x", "mean", label="label")


@query("win11_weighted_stack", "subject_id:i i:i j:i w:d", """
    SELECT subject_id, i, j, sum(q * w) / greatest(sum(q), 1e-8) AS w FROM (SELECT *, 1.0 / (1 + segment_id) AS q FROM v_edges) GROUP BY 1, 2, 3""")
def _(t):
    e = t.edges.withColumn("q", 1.0 / (1 + F.col("segment_id")))
    return win.weighted_mean(e, ["subject_id", "i", "j"], "w", "q")


_M12 = "WITH m AS (SELECT *, start_sample // 20 AS macro_id, subject_id % 3 AS label, CASE subject_id % 5 WHEN 0 THEN 'test' ELSE 'train' END AS split FROM v_windex), " \
       "s AS (SELECT split, label, subject_id, count(*) AS n_macros, sum(k) AS n_segments, avg(k) AS mean_segments_per_macro, (max(hi) - min(lo)) / 8 AS duration_sec " \
       "FROM (SELECT split, label, subject_id, macro_id, count(*) AS k, min(start_sample) AS lo, max(end_sample) AS hi FROM m GROUP BY ALL) GROUP BY 1, 2, 3) "


def _macros(t):
    w = t.window_index.withColumn("label", F.col("subject_id") % 3).withColumn(
        "split", F.when(F.col("subject_id") % 5 == 0, "test").otherwise("train"))
    return win.macro_report(win.macro_groups(w, duration=20, rule="start"), FS)


@query("win12_macro_report", "split:s label:i subject_id:i n_macros:i n_segments:i mean_segments_per_macro:d duration_sec:d", _M12 + "SELECT * FROM s")
def _(t):
    return _macros(t)[0]


@query("win12_macro_report_by_class", "split:s label:i n_subjects:i mean_n_macros:d std_n_macros:d min_duration_sec:d max_duration_sec:d mean_mean_segments_per_macro:d",
       _M12 + """SELECT split, label, count(*) AS n_subjects, avg(n_macros) AS mean_n_macros, stddev_pop(n_macros) AS std_n_macros,
       min(duration_sec) AS min_duration_sec, max(duration_sec) AS max_duration_sec, avg(mean_segments_per_macro) AS mean_mean_segments_per_macro FROM s GROUP BY 1, 2""")
def _(t):
    return _macros(t)[1]


@query("win13_spectrogram", "subject_id:i segment_id:i channel:s part:i f:i frame:i value:d", f"""
    SELECT {WCH}, part, f, fr AS frame, CASE part WHEN 0 THEN re ELSE im END AS value FROM (
      SELECT {WCH}, fr, f, sum(value * (0.5 - 0.5 * cos(2 * pi() * m / 6)) * cos(2 * pi() * f * m / 6)) AS re, -sum(value * (0.5 - 0.5 * cos(2 * pi() * m / 6)) * sin(2 * pi() * f * m / 6)) AS im
      FROM (SELECT fr, m, 3 * fr + m - 3 AS q FROM range(3) a(fr), range(6) b(m)) z
      JOIN v_windows v ON v.k = CASE WHEN q < 0 THEN -q WHEN q > 7 THEN 14 - q ELSE q END, range(4) c(f) GROUP BY {WCH}, fr, f), range(2) p(part)""")
def _(t):
    return rec.spectrogram(t.windows, 0.5, "as_real")


@query("win14_balanced_crops", "n_records:i crops_per_record:i total_crops:i",
       "SELECT n AS n_records, CAST(ceil(1000.0 / n) AS BIGINT) AS crops_per_record, CAST(ceil(1000.0 / n) AS BIGINT) * n AS total_crops FROM (SELECT count(DISTINCT user_id) AS n FROM events)")
def _(t):
    r = t.table("events").select(F.col("user_id").alias("subject_id")).distinct()
    return win.crops_per_recording(r, 1000)


# ---------------------------------------------------------------------------------------- features

_DIFF = f"(SELECT *, value - lag(value) OVER w AS d, lag(value) OVER w AS prev FROM v_windows WINDOW w AS (PARTITION BY {WCH} ORDER BY k))"


@query("sig01_time_stats", "subject_id:i segment_id:i channel:s mean:d std:d skew:d kurtosis:d min:d max:d ptp:d rms:d line_length:d zero_cross_rate:d", f"""
    SELECT {WCH}, avg(value) AS mean, stddev_pop(value) AS std, coalesce(skewness(value), 0) AS skew, coalesce(kurtosis(value) + 3, 0) AS kurtosis,
      min(value) AS min, max(value) AS max, max(value) - min(value) AS ptp, sqrt(avg(value * value)) AS rms, sum(abs(d)) / 7 AS line_length,
      sum(CASE WHEN (value < 0) <> (prev < 0) THEN 1 ELSE 0 END) / 7 AS zero_cross_rate FROM {_DIFF} GROUP BY 1, 2, 3""")
def _(t):
    return ft.time_stats(t.windows)


_HJ = f"""(SELECT {WCH}, var_pop(value) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM (
      SELECT *, d - lag(d) OVER (PARTITION BY {WCH} ORDER BY k) AS dd FROM {_DIFF}) GROUP BY 1, 2, 3)"""


@query("sig02_hjorth", "subject_id:i segment_id:i channel:s hjorth_activity:d hjorth_mobility:d hjorth_complexity:d", f"""
    SELECT {WCH}, v0 AS hjorth_activity, sqrt(v1 / greatest(v0, 1e-8)) AS hjorth_mobility,
      sqrt(v2 / greatest(v1, 1e-8)) / greatest(sqrt(v1 / greatest(v0, 1e-8)), 1e-8) AS hjorth_complexity FROM {_HJ}""")
def _(t):
    return ft.hjorth(t.windows)


@query("sig02_hjorth_zero_guard", "subject_id:i segment_id:i channel:s hjorth_mobility:d hjorth_complexity:d", f"""
    SELECT {WCH}, sqrt(v1 / v0) AS hjorth_mobility, sqrt(v2 / v1) / sqrt(v1 / v0) AS hjorth_complexity FROM {_HJ} WHERE v0 > 0 AND v1 > 0""")
def _(t):
    return ft.hjorth(t.windows, guard="zero")


def dft_sql(nper: int) -> str:
    """(window, channel, frame, f, re, im) of mean-free Hann frames of ``nper`` samples, half overlapping, for 8-sample windows."""
    n_frames = (8 - nper) // (nper - nper // 2) + 1
    return f"""SELECT {WCH}, fr, f, sum(z * cos(2 * pi() * f * m / {nper})) AS re, -sum(z * sin(2 * pi() * f * m / {nper})) AS im FROM (
        SELECT *, (value - avg(value) OVER (PARTITION BY {WCH}, fr)) * (0.5 - 0.5 * cos(2 * pi() * m / {nper})) AS z FROM (
          SELECT *, k - fr * {nper - nper // 2} AS m FROM v_windows, range({n_frames}) q(fr)) WHERE m >= 0 AND m < {nper}), range({nper // 2 + 1}) p(f)
      GROUP BY {WCH}, fr, f"""


def psd_sql(nper: int) -> str:
    hann = sum((0.5 - 0.5 * __import__("math").cos(2 * __import__("math").pi * i / nper)) ** 2 for i in range(nper))
    return f"""SELECT {WCH}, f, f * 8.0 / {nper} AS hz, avg(re * re + im * im) / (8 * {hann!r}) * CASE WHEN f IN (0, {nper // 2}) THEN 1 ELSE 2 END AS p
      FROM ({dft_sql(nper)}) GROUP BY {WCH}, f"""


@query("sig03_welch_psd", "subject_id:i segment_id:i channel:s f:i p:d9", psd_sql(4))
def _(t):
    return ft.welch_psd(t.windows, FS, 4).select("subject_id", "segment_id", "channel", F.posexplode_outer("psd").alias("f", "p"))


@query("sig03_periodogram", "subject_id:i segment_id:i channel:s f:i p:d9", psd_sql(8))
def _(t):
    return ft.welch_psd(t.windows, FS, "min256").select("subject_id", "segment_id", "channel", F.posexplode_outer("psd").alias("f", "p"))


_BANDS_SQL = "(VALUES ('low', 0.0, 2.0), ('mid', 1.0, 4.0), ('high', 3.0, 5.0)) b(band, lo, hi)"
_BP = f"""SELECT {WCH}, band, sum((p + q) / 2) AS absolute FROM (
      SELECT *, lag(p) OVER (PARTITION BY {WCH}, band ORDER BY hz) AS q FROM ({psd_sql(8)}), {_BANDS_SQL} WHERE hz >= lo AND hz < hi) GROUP BY {WCH}, band"""


def _by_band(df, cols):
    names = F.array(*[F.lit(b) for b in BANDS8])
    z = F.arrays_zip(names.alias("band"), *[F.col(c) for c in cols])
    return df.select("subject_id", "segment_id", "channel", F.explode_outer(z).alias("z")).select(
        "subject_id", "segment_id", "channel", F.col("z.band"), *[F.col(f"z.{c}") for c in cols])


@query("sig04_band_power", "subject_id:i segment_id:i channel:s band:s absolute:d5 relative:d log:d",
       f"SELECT *, absolute / greatest(sum(absolute) OVER (PARTITION BY {WCH}), 1e-8) AS relative, ln(1 + absolute) AS log FROM ({_BP})")
def _(t):
    return _by_band(ft.band_power(ft.welch_psd(t.windows, FS), BANDS8), ["absolute", "relative", "log"])


@query("sig05_band_sums", "subject_id:i segment_id:i channel:s band:s mean:d5 share:d log10:d log_share:d", f"""
    SELECT {WCH}, band, avg(p) AS mean, sum(p) / min(tot) AS share, log10(sum(p)) AS log10, ln((sum(p) + 1e-12) / (min(uni) + 1e-12)) AS log_share
    FROM (SELECT *, sum(p) OVER (PARTITION BY {WCH}) AS tot, sum(CASE WHEN hz <= 5 THEN p END) OVER (PARTITION BY {WCH}) AS uni FROM ({psd_sql(8)})), {_BANDS_SQL}
    WHERE hz >= lo AND hz <= hi GROUP BY {WCH}, band""")
def _(t):
    return _by_band(ft.band_sums(ft.welch_psd(t.windows, FS, "one_sec"), BANDS8), ["mean", "share", "log10", "log_share"])


@query("sig06_entropies", "subject_id:i segment_id:i channel:s entropy_spectral:d entropy_amplitude:d entropy_differential:d", f"""
    WITH s AS (SELECT {WCH}, -sum(CASE WHEN q > 0 THEN q * ln(q) ELSE 0 END) / ln(5) AS es FROM (
      SELECT {WCH}, p / sum(p) OVER (PARTITION BY {WCH}) AS q FROM ({psd_sql(8)})) GROUP BY 1, 2, 3),
    a AS (SELECT {WCH}, -sum(c / 8 * ln(c / 8)) / ln(32) AS ea FROM (SELECT {WCH}, bin, count(*) AS c FROM (
      SELECT {WCH}, least(CAST(floor((value - lo) / (hi - lo) * 32) AS BIGINT), 31) AS bin FROM (
        SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM v_windows WINDOW w AS (PARTITION BY {WCH}))) GROUP BY ALL) GROUP BY 1, 2, 3),
    d AS (SELECT {WCH}, 0.5 * ln(2 * pi() * exp(1) * greatest(var_pop(value), 1e-8)) AS ed FROM v_windows GROUP BY 1, 2, 3)
    SELECT {WCH}, es AS entropy_spectral, ea AS entropy_amplitude, ed AS entropy_differential FROM s JOIN a USING ({WCH}) JOIN d USING ({WCH})""")
def _(t):
    return ft.entropies(ft.welch_psd(t.windows, FS))


def _wavelet_level(n, level, out):
    """One step of the transform over rows (k, v) of a block of n samples: low pass v and high pass d at every second place."""
    at = f"(2 * o + 1 + j - 7 + {2 * n}) % {2 * n}"
    return f"""l{level} AS (SELECT {WCH}, o AS k, sum(lo * v) AS v, sum(hi * v) AS d FROM (SELECT o, lo, hi, CASE WHEN {at} < {n} THEN {at} ELSE {2 * n - 1} - {at} END AS src
      FROM range({out}) q(o), taps) z JOIN l{level - 1} p ON p.k = src GROUP BY {WCH}, o)"""


def _wavelet_sql():
    n = len(DB4_LOWPASS)
    taps = ", ".join(f"({j}, {DB4_LOWPASS[n - 1 - j]!r}, {DB4_LOWPASS[j] * (1 if j % 2 == 0 else -1)!r})" for j in range(n))
    levels, size = [], 8
    for level in range(1, 6):
        out = (size + 7) // 2
        levels.append(_wavelet_level(size, level, out))
        size = out
    bands = " UNION ALL ".join([f"SELECT {WCH}, 0 AS band, sum(v * v) AS energy FROM l5 GROUP BY {WCH}",
                                *[f"SELECT {WCH}, {6 - lv} AS band, sum(d * d) AS energy FROM l{lv} GROUP BY {WCH}" for lv in range(1, 6)]])
    return f"WITH taps(j, lo, hi) AS (VALUES {taps}), l0 AS (SELECT {WCH}, k, value AS v FROM v_windows), {', '.join(levels)} {bands}"


@query("sig07_wavelet_energy", "subject_id:i segment_id:i channel:s band:i energy:d3", _wavelet_sql())
def _(t):
    return ft.wavelet_energy(t.windows).select("subject_id", "segment_id", "channel", F.posexplode_outer("energy").alias("band", "energy"))


@query("sig08_higuchi", "subject_id:i segment_id:i channel:s higuchi_fd:d", f"""
    WITH km AS (SELECT kk, m FROM range(1, 9) a(kk), range(0, 8) b(m) WHERE m < kk AND m + kk <= 7),
    l AS (SELECT {WCH}, kk, m, sum(abs(dv)) * 7 / (((7 - m) // kk) * kk) / kk AS lm FROM (
      SELECT v.*, kk, m, value - lag(value) OVER (PARTITION BY {WCH}, kk, m ORDER BY k) AS dv FROM v_windows v, km WHERE k >= m AND (k - m) % kk = 0) GROUP BY {WCH}, kk, m)
    SELECT {WCH}, regr_slope(ln(lk), ln(1.0 / kk)) AS higuchi_fd FROM (SELECT {WCH}, kk, avg(lm) AS lk FROM l GROUP BY {WCH}, kk) GROUP BY 1, 2, 3""")
def _(t):
    return ft.higuchi(t.windows)


@query("sig09_feature_ratio", "subject_id:i segment_id:i channel:s alpha_theta_ratio:d", f"""
    WITH b AS (SELECT {WCH}, max(CASE WHEN band = 'mid' THEN r END) AS a, max(CASE WHEN band = 'low' THEN r END) AS th FROM (
      SELECT *, absolute / sum(absolute) OVER (PARTITION BY {WCH}) AS r FROM ({_BP})) GROUP BY 1, 2, 3)
    SELECT {WCH}, a / (abs(th) + 1e-8) AS alpha_theta_ratio FROM b""")
def _(t):
    b = ft.band_power(ft.welch_psd(t.windows, FS), BANDS8)
    w = b.withColumn("rbp_mid", F.element_at("relative", 2)).withColumn("rbp_low", F.element_at("relative", 1))
    return ft.derived_ratio(w, ["rbp_alpha", "rbp_mid"], ["rbp_theta", "rbp_low"], "alpha_theta_ratio")


_QC = f"""SELECT subject_id, segment_id, max(amax) AS max_abs_uv, max(ptp) AS max_ptp_uv, quantile_cont(ptp, 0.5) AS median_ptp_uv, min(gstd) AS global_std_uv,
      avg(CASE WHEN sd < 0.05 THEN 1.0 ELSE 0.0 END) AS flat_channel_frac, avg(CASE WHEN coalesce(ku, 0) > 8 THEN 1.0 ELSE 0.0 END) AS high_kurtosis_frac,
      count(*) AS num_channels, min(nk) AS num_samples FROM (
        SELECT {WCH}, max(abs(value)) AS amax, max(value) - min(value) AS ptp, stddev_pop(value) AS sd, kurtosis(value) + 3 AS ku, count(*) AS nk, min(g) AS gstd
        FROM (SELECT v.*, g FROM v_windows v JOIN (SELECT subject_id, segment_id, stddev_pop(value) AS g FROM v_windows GROUP BY 1, 2) USING (subject_id, segment_id))
        GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("sig10_extended_qc", "subject_id:i segment_id:i max_abs_uv:d median_ptp_uv:d rel_low_mean:d rel_high_mean:d posterior_mid_rel:d slow_fast_ratio:d hf_lf_ratio:d", f"""
    WITH p AS (SELECT {WCH}, max(CASE WHEN band = 'low' THEN absolute END) AS l, max(CASE WHEN band = 'mid' THEN absolute END) AS m,
        max(CASE WHEN band = 'high' THEN absolute END) AS h FROM ({_BP}) GROUP BY 1, 2, 3),
    t AS (SELECT {WCH}, sum((p + q) / 2) AS tot FROM (SELECT *, lag(p) OVER (PARTITION BY {WCH} ORDER BY hz) AS q FROM ({psd_sql(8)}) WHERE hz < 5) GROUP BY 1, 2, 3),
    r AS (SELECT subject_id, segment_id, avg(l / (tot + 1e-12)) AS rel_low_mean, avg(h / (tot + 1e-12)) AS rel_high_mean,
        avg(CASE WHEN channel IN ('view', 'click') THEN m / (tot + 1e-12) END) AS posterior_mid_rel, avg(h) / avg(l + 1e-12) AS hf_lf_ratio FROM p JOIN t USING ({WCH}) GROUP BY 1, 2)
    SELECT *, rel_low_mean / (rel_high_mean + 1e-12) AS slow_fast_ratio FROM r JOIN ({_QC}) USING (subject_id, segment_id)""")
def _(t):
    sp = ft.welch_psd(t.windows, FS)
    p = ft.band_power(sp, BANDS8).select("subject_id", "segment_id", "channel", "absolute", "psd", "df")
    p = p.withColumn("total", ft._trapezoid(ft._band(0, 5)))
    return qc.extended_metrics(qc.window_metrics(t.windows), p, list(BANDS8), slow=["low"], fast=["high"], posterior=["view", "click"],
                               focus="mid", high="high", low="low")


@query("sig11_feature_set", "subject_id:i segment_id:i channel:s ord:i family:s feature:s value:d10", f"""
    WITH f AS (SELECT {WCH}, var_pop(value) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2, avg(value) AS mean, stddev_pop(value) AS std, skewness(value) AS skew,
        kurtosis(value) + 3 AS kurtosis, min(value) AS min, max(value) AS max, max(value) - min(value) AS ptp, sqrt(avg(value * value)) AS rms,
        sum(abs(d)) / 7 AS line_length, sum(CASE WHEN (value < 0) <> (prev < 0) THEN 1 ELSE 0 END) / 7 AS zc FROM (
          SELECT *, d - lag(d) OVER (PARTITION BY {WCH} ORDER BY k) AS dd FROM {_DIFF}) GROUP BY 1, 2, 3),
    b AS (SELECT {WCH}, band, absolute / greatest(sum(absolute) OVER (PARTITION BY {WCH}), 1e-8) AS r FROM ({_BP}))
    SELECT {WCH}, u.ord, 'hjorth' AS family, u.feature, u.value FROM f, LATERAL (VALUES (0, 'hjorth_activity', v0), (1, 'hjorth_mobility', sqrt(v1 / greatest(v0, 1e-8))),
        (2, 'hjorth_complexity', sqrt(v2 / greatest(v1, 1e-8)) / greatest(sqrt(v1 / greatest(v0, 1e-8)), 1e-8))) u(ord, feature, value)
    UNION ALL SELECT {WCH}, 3 + CASE band WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END, 'bandpower', 'rbp_' || band, r FROM b
    UNION ALL SELECT {WCH}, u.ord, 'time', u.feature, u.value FROM f, LATERAL (VALUES (6, 'mean', mean), (7, 'std', std), (8, 'skew', coalesce(skew, 0)),
        (9, 'kurtosis', coalesce(kurtosis, 0)), (10, 'min', min), (11, 'max', max), (12, 'ptp', ptp), (13, 'rms', rms), (14, 'line_length', line_length),
        (15, 'zero_cross_rate', zc)) u(ord, feature, value)""")
def _(t):
    return ft.feature_set(t.windows.drop("start_sample", "end_sample"), ["hjorth", "rbp", "stats", "relative_band_power"], FS, BANDS8)


@query("sig12_bandpass_recording", "subject_id:i channel:s t:i value:d")
def _(t):
    return rec.bandpass_recording(t.samples, FS, 0.5, 3.0, block=32, short="keep")


def _notch_sql(freq, q, pad=9):
    """Zero-phase notch of each recording, sample by sample: odd padding, one pass forward and one backward from the steady state of the first value."""
    pass_ = """{name}(subject_id, channel, k, z0, z1, y) AS (
      SELECT subject_id, channel, 0, zi0 * x[1], zi1 * x[1], CAST(NULL AS DOUBLE) FROM {src}, c
      UNION ALL SELECT r.subject_id, r.channel, k + 1, b1 * v - b1 * (b0 * v + z0) + z1, b0 * v - a2 * (b0 * v + z0), b0 * v + z0
      FROM (SELECT r.*, p.x[r.k + 1] AS v FROM {name} r JOIN {src} p ON p.subject_id = r.subject_id AND p.channel = r.channel WHERE r.k < len(p.x)) r, c)"""
    turn = "{name} AS MATERIALIZED (SELECT subject_id, channel, list(y ORDER BY k DESC) AS x FROM {src} WHERE k > 0 GROUP BY 1, 2)"
    return f"""
    WITH RECURSIVE c AS MATERIALIZED (SELECT *, b1 * (1 - 1) + b0 - a2 AS zi0, b0 - a2 AS zi1 FROM (SELECT g AS b0, -2 * g * cos(w) AS b1, 2 * g - 1 AS a2 FROM (
      SELECT w, 1 / (1 + tan(w / {q} / 2)) AS g FROM (SELECT 2 * pi() * {freq} / {FS} AS w)))),
    s AS MATERIALIZED (SELECT subject_id, channel, list(value ORDER BY t) AS x FROM v_samples GROUP BY 1, 2),
    p AS MATERIALIZED (SELECT subject_id, channel, list_concat(list_concat(list_transform(range({pad}), lambda i: 2 * x[1] - x[{pad + 1} - i]), x), list_transform(range({pad}), lambda i: 2 * x[len(x)] - x[len(x) - 1 - i])) AS x
      FROM s WHERE len(x) > {pad}),
    {pass_.format(name="f", src="p")}, {turn.format(name="g", src="f")}, {pass_.format(name="h", src="g")}, {turn.format(name="o", src="h")}
    SELECT subject_id, channel, unnest(range(len(x) - {2 * pad})) AS t, unnest(x[{pad + 1} : len(x) - {pad}]) AS value FROM o
    UNION ALL SELECT subject_id, channel, unnest(range(len(x))), unnest(x) FROM s WHERE len(x) <= {pad}"""


@query("sig12_notch_recording", "subject_id:i channel:s t:i value:d", _notch_sql(2.0, 30))
def _(t):
    return rec.notch_recording(t.samples, FS, 2.0, block=32, short="keep")


@query("sig13_resample", "subject_id:i segment_id:i channel:s k:i value:d", f"""
    WITH raw AS (SELECT k, (CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / 3) / (pi() * k / 3) END) * (
        SELECT sum(pow(6.25 * (1 - pow(k / 30.0, 2)), j) / pow(CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE), 2)) FROM range(30) q(j)) AS h FROM range(-30, 31) r(k)),
    h AS (SELECT k, 3 * h / (SELECT sum(h) FROM raw) AS h FROM raw),
    e AS (SELECT {WCH}, max(value) FILTER (WHERE k = 0) AS a, max(value) FILTER (WHERE k = 7) AS b FROM v_windows GROUP BY ALL),
    y AS (SELECT {WCH}, j, sum((value - a - (b - a) * v.k / 7) * h.h) + any_value(a + (b - a) * 2 * j / 21) AS value
      FROM v_windows v JOIN e USING ({WCH}), range(11) q(j) JOIN h ON h.k = 2 * j - 3 * v.k GROUP BY {WCH}, j)
    SELECT {WCH}, j AS k, value FROM y UNION ALL SELECT {WCH}, 11, value FROM y WHERE j = 10""")
def _(t):
    return rec.resample_windows(t.windows, FS, 12.0).select("subject_id", "segment_id", "channel", F.posexplode_outer("x").alias("k", "value"))


@query("sig14_node_features", "subject_id:i segment_id:i channel:s feature:i value:d10", f"""
    WITH b AS (SELECT {WCH}, band, log10(sum(p)) AS v FROM ({psd_sql(8)}), {_BANDS_SQL} WHERE hz >= lo AND hz <= hi GROUP BY {WCH}, band)
    SELECT {WCH}, CASE band WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END AS feature, v AS value FROM b
    UNION ALL SELECT {WCH}, u.f, u.v FROM {_HJ} h, LATERAL (VALUES (3, v0), (4, sqrt(v1 / v0)), (5, sqrt(v2 / v1) / sqrt(v1 / v0))) u(f, v)""")
def _(t):
    return rec.node_features(t.windows, FS, BANDS8, ["rbp", "hjorth"])


# ---------------------------------------------------------------------------------------- quality

_LIM = [("max_abs_uv", 150.0), ("max_ptp_uv", 180.0), ("global_std_uv", 60.0), ("flat_channel_frac", 0.3), ("high_kurtosis_frac", 0.1)]
_FLAG = "SELECT *, concat_ws(';', " + ", ".join(f"CASE WHEN {n} > {v} THEN '{n}>{v}' END" for n, v in _LIM) + ") AS artifact_reasons, (" + \
        " OR ".join(f"{n} > {v}" for n, v in _LIM) + f") AS bad_segment_flag FROM ({_QC})"


@query("qc01_window_metrics", "subject_id:i segment_id:i max_abs_uv:d max_ptp_uv:d median_ptp_uv:d global_std_uv:d flat_channel_frac:d high_kurtosis_frac:d num_channels:i num_samples:i", _QC)
def _(t):
    return qc.window_metrics(t.windows)


def _flags(t):
    return qc.flag_windows(qc.window_metrics(t.windows), _LIM)


@query("qc02_window_flags", "subject_id:i segment_id:i bad_segment_flag:b artifact_reasons:s", _FLAG)
def _(t):
    return _flags(t)


@query("qc03_drop_bad_windows", "subject_id:i segment_id:i", f"""
    WITH f AS ({_FLAG}), c AS (SELECT subject_id, count(*) FILTER (WHERE NOT bad_segment_flag) AS g FROM f GROUP BY 1)
    SELECT subject_id, segment_id FROM (SELECT f.*, row_number() OVER (PARTITION BY subject_id ORDER BY md5(concat_ws('|', 9, subject_id, segment_id)), segment_id) AS r
      FROM f JOIN c USING (subject_id) WHERE NOT bad_segment_flag AND g >= 2) WHERE r <= 12""")
def _(t):
    return qc.drop_bad_windows(_flags(t), min_valid=2, max_windows=12, seed=9)[0]


@query("qc03_drop_summary", "subject_id:i n_windows:i n_good:i n_bad:i bad_fraction:d subject_kept:b n_kept:i", f"""
    SELECT subject_id, n AS n_windows, g AS n_good, n - g AS n_bad, (n - g) / n AS bad_fraction, g >= 2 AS subject_kept, CASE WHEN g >= 2 THEN least(g, 12) ELSE 0 END AS n_kept
    FROM (SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE NOT bad_segment_flag) AS g FROM ({_FLAG}) GROUP BY 1)""")
def _(t):
    return qc.drop_bad_windows(_flags(t), min_valid=2, max_windows=12, seed=9)[1]


@query("qc03_good_windows", "subject_id:i segment_id:i", f"""
    WITH f AS ({_FLAG}), c AS (SELECT subject_id, count(*) FILTER (WHERE NOT bad_segment_flag) AS g FROM f GROUP BY 1)
    SELECT subject_id, segment_id FROM f JOIN c USING (subject_id) WHERE NOT bad_segment_flag AND g >= 2""")
def _(t):
    return qc.drop_bad_windows(_flags(t), min_valid=2, seed=9)[0]


@query("qc03_good_summary", "subject_id:i n_windows:i n_good:i n_bad:i bad_fraction:d subject_kept:b n_kept:i", f"""
    SELECT subject_id, n AS n_windows, g AS n_good, n - g AS n_bad, (n - g) / n AS bad_fraction, g >= 2 AS subject_kept, CASE WHEN g >= 2 THEN g ELSE 0 END AS n_kept
    FROM (SELECT subject_id, count(*) AS n, count(*) FILTER (WHERE NOT bad_segment_flag) AS g FROM ({_FLAG}) GROUP BY 1)""")
def _(t):
    return qc.drop_bad_windows(_flags(t), min_valid=2, seed=9)[1]


@query("qc04_prepared_windows", "subject_id:i segment_id:i channel:s k:i value:d")
def _(t):
    p = rec.prepare(t.samples, FS, band=(0.5, 3.0), reference="average", window_sec=1.0, overlap=0.5, normalize="per_channel", block=64, short="keep")
    return p["windows"].select("subject_id", "segment_id", "channel", F.posexplode_outer("x").alias("k", "value"))


_SUBJ = f"""SELECT subject_id, subject_id % 3 AS label_id, count(*) AS n_windows, count(*) FILTER (WHERE bad_segment_flag) AS n_artifact,
      100 * avg(CASE WHEN bad_segment_flag THEN 1.0 ELSE 0.0 END) AS pct_artifact, avg(max_abs_uv) AS mean_max_abs_uv, avg(global_std_uv) AS mean_global_std_uv FROM ({_FLAG}) GROUP BY 1"""


@query("qc05_subject_quality", "subject_id:i n_windows:i n_artifact:i pct_artifact:d mean_max_abs_uv:d mean_global_std_uv:d", _SUBJ)
def _(t):
    return qc.subject_quality(_flags(t))


@query("qc05_class_quality", "label_id:i mean:d std:d median:d n_subjects:i",
       f"SELECT label_id, avg(pct_artifact) AS mean, stddev_samp(pct_artifact) AS std, quantile_cont(pct_artifact, 0.5) AS median, count(*) AS n_subjects FROM ({_SUBJ}) GROUP BY 1")
def _(t):
    return qc.class_quality(qc.subject_quality(_flags(t)).withColumn("label_id", F.col("subject_id") % 3))


