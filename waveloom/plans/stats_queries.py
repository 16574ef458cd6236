"""Queries for statistics (STA)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import projections as prj
from ..operators import stats as st
from .registry import query
from .signal_queries import WCH

_NAMES = ["time__mean", "time__std", "time__ptp", "hjorth__mobility"]
_WIDE = f"""(SELECT {WCH}, avg(value) AS time__mean, stddev_pop(value) AS time__std, max(value) - min(value) AS time__ptp, sqrt(var_pop(d) / greatest(var_pop(value), 1e-8)) AS hjorth__mobility,
      CASE subject_id % 5 WHEN 0 THEN 'Test' ELSE 'Train' END AS data_split, 'class_' || (subject_id % 3) AS class_label
    FROM (SELECT *, value - lag(value) OVER (PARTITION BY {WCH} ORDER BY k) AS d FROM v_windows) GROUP BY 1, 2, 3)"""
_KEYS = ["subject_id", "segment_id", "channel"]


def _long(t):
    w = ft.hjorth(ft.time_stats(t.windows))
    cell = lambda fam, name, col: F.struct(F.lit(fam).alias("family"), F.lit(name).alias("feature"), F.col(col).alias("value"))
    cells = F.array(cell("time", "mean", "mean"), cell("time", "std", "std"), cell("time", "ptp", "ptp"), cell("hjorth", "mobility", "hjorth_mobility"))
    return w.select(*_KEYS, F.explode(cells).alias("f")).select(*_KEYS, "f.*")


def _wide(t):
    w = st.wide_features(_long(t), _KEYS, _NAMES)
    return w.withColumn("data_split", F.when(F.col("subject_id") % 5 == 0, "Test").otherwise("Train")).withColumn("class_label", F.concat(F.lit("class_"), F.col("subject_id") % 3))


@query("sta01_wide_features", "subject_id:i segment_id:i channel:s time__mean:d9 time__std:d time__ptp:d hjorth__mobility:d", f"SELECT * FROM {_WIDE}")
def _(t):
    return _wide(t)


_UNPIV = f"(SELECT *, split_part(feature_key, '__', 1) AS family, split_part(feature_key, '__', 2) AS feature FROM (UNPIVOT {_WIDE} ON time__mean, time__std, time__ptp, hjorth__mobility INTO NAME feature_key VALUE value))"


@query("sta02_long_features", "subject_id:i segment_id:i channel:s family:s feature:s value:d9", f"SELECT * FROM {_UNPIV}")
def _(t):
    return st.long_features(_wide(t), _KEYS, _NAMES)


@query("sta03_split_class_summary", "data_split:s class_label:s feature_key:s n:i mean:d std:d min:d9 max:d9", f"""
    SELECT data_split, class_label, feature_key, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max FROM {_UNPIV} GROUP BY 1, 2, 3""")
def _(t):
    return st.split_class_summary(st.long_features(_wide(t), [*_KEYS, "data_split", "class_label"], _NAMES))


@query("sta04_connectivity_summary", "data_split:s class_label:s metric:s band:s n_values:i n_subjects:i n_channels:i mean:d std:d sem:d cv:d q05:d median:d q95:d iqr:d range:d", """
    WITH ch AS (SELECT subject_id, i AS channel, avg(abs(w)) AS value, 'class_' || label AS class_label, CASE subject_id % 5 WHEN 0 THEN 'Test' ELSE 'Train' END AS data_split,
        CASE WHEN i < 8 THEN 'low' ELSE 'high' END AS band, 'cos' AS metric FROM v_both GROUP BY subject_id, i, label)
    SELECT CASE WHEN grouping(data_split) = 1 THEN 'ALL' ELSE data_split END AS data_split, CASE WHEN grouping(class_label) = 1 THEN 'ALL' ELSE class_label END AS class_label, metric,
      CASE WHEN grouping(band) = 1 THEN 'ALL' ELSE band END AS band, count(*) AS n_values, count(DISTINCT subject_id) AS n_subjects, count(DISTINCT channel) AS n_channels, avg(value) AS mean, stddev_samp(value) AS std,
      stddev_samp(value) / sqrt(count(*)) AS sem, stddev_samp(value) / avg(value) AS cv, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.95) AS q95,
      quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, max(value) - min(value) AS range
    FROM ch GROUP BY GROUPING SETS ((data_split, class_label, metric, band), (class_label, metric, band), (data_split, metric, band), (metric, band), (data_split, class_label, metric), (class_label, metric), (data_split, metric), (metric))""")
def _(t):
    from ..operators import connectivity as con

    s = con.subject_summary(t.edges, value="w", by=["subject_id", "label"]).filter("level = 'channel'")
    s = s.select("subject_id", "channel", "value", F.concat(F.lit("class_"), "label").alias("class_label"), F.when(F.col("subject_id") % 5 == 0, "Test").otherwise("Train").alias("data_split"),
                 F.when(F.col("channel") < 8, "low").otherwise("high").alias("band"), F.lit("cos").alias("metric"))
    return st.connectivity_summary(s, all_classes=True)


@query("sta05_outlier_tracker", "class_label:s subject_id:i data_split:s time__ptp__mean:d time__ptp__class_z:d time__mean__mean:d is_outlier:b outlier_reasons:s", f"""
    WITH s AS (SELECT class_label, subject_id, data_split, avg(time__ptp) AS time__ptp__mean, avg(time__mean) AS time__mean__mean FROM {_WIDE} GROUP BY 1, 2, 3),
    z AS (SELECT *, (time__ptp__mean - avg(time__ptp__mean) OVER w) / (nullif(stddev_samp(time__ptp__mean) OVER w, 0) + 1e-8) AS time__ptp__class_z FROM s WINDOW w AS (PARTITION BY class_label))
    SELECT *, coalesce(time__ptp__class_z > 1, false) AS is_outlier, CASE WHEN time__ptp__class_z > 1 THEN 'time__ptp z>1.0; ' ELSE '' END AS outlier_reasons FROM z""")
def _(t):
    return st.outlier_tracker(_wide(t), ["time__ptp"], ["time__mean"], limit=1.0)


@query("sta06_channel_means", "subject_id:i channel:s feature:s value:d9", f"SELECT subject_id, channel, feature, avg(value) AS value FROM {_UNPIV} GROUP BY 1, 2, 3")
def _(t):
    return st.channel_tables(_long(t))[1]


@query("sta06_channel_flat", "subject_id:i click__ptp:d9 view__ptp:d9", f"""
    SELECT subject_id, avg(time__ptp) FILTER (WHERE channel = 'click') AS click__ptp, avg(time__ptp) FILTER (WHERE channel = 'view') AS view__ptp FROM {_WIDE} GROUP BY 1""")
def _(t):
    return st.channel_tables(_long(t), ["click__ptp", "view__ptp"])[2]


def anova_sql(keys, src, label="label", value="value"):
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}sum(n) AS n, count(*) AS k, (sum(n * pow(m - mm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_stat FROM (
      SELECT *, sum(n * m) OVER w / sum(n) OVER w AS mm FROM (SELECT {k}{label}, count(*) AS n, avg({value}) AS m, var_pop({value}) AS v FROM {src} GROUP BY ALL)
      WINDOW w AS ({f'PARTITION BY {keys}' if keys else ''})) {f'GROUP BY {keys}' if keys else ''}"""


@query("sta07_anova", "feature:s n:i k:i f_stat:d", anova_sql("feature", f"(SELECT feature, subject_id % 3 AS label, subject_id, segment_id, avg(value) AS value FROM {_UNPIV} GROUP BY ALL)"))
def _(t):
    w = _long(t).groupBy("feature", "subject_id", "segment_id").agg(F.avg("value").alias("value"))
    return st.anova(w.withColumn("label", F.col("subject_id") % 3), ["feature"])


@query("sta08_edge_anova", "i:i j:i n:i k:i f_stat:d", anova_sql("i, j", "v_edges", value="w"))
def _(t):
    return st.edge_anova(t.edges)


@query("sta08_edge_anova_fdr", "i:i j:i p_val:d p_corrected:d significant:b")
def _(t):
    return st.edge_anova(t.edges)


@query("sta08_bh_adjust", "instance_id:i split:s p_val:d9 p_corrected:d9", """
    SELECT instance_id, split, p_val, least(1, min(p_val * n / r) OVER (PARTITION BY split ORDER BY p_val DESC, instance_id DESC ROWS UNBOUNDED PRECEDING)) AS p_corrected FROM (
      SELECT instance_id, split, p_val, count(*) OVER (PARTITION BY split) AS n, rank() OVER (PARTITION BY split ORDER BY p_val) + count(*) OVER (PARTITION BY split, p_val) - 1 AS r FROM (
        SELECT instance_id, split, p0 * p0 * p0 AS p_val FROM v_preds))""")
def _(t):
    return st.bh_adjust(t.preds.withColumn("p_val", F.get("prob", 0) * F.get("prob", 0) * F.get("prob", 0)), ["split"])


@query("sta09_top_edges", "i:i j:i f_stat:d mean_class_0:d mean_class_1:d mean_class_2:d", f"""
    SELECT i, j, f_stat, avg(w) FILTER (WHERE label = 0) AS mean_class_0, avg(w) FILTER (WHERE label = 1) AS mean_class_1, avg(w) FILTER (WHERE label = 2) AS mean_class_2
    FROM (SELECT * FROM ({anova_sql('i, j', 'v_edges', value='w')}) ORDER BY f_stat DESC, i, j LIMIT 20) JOIN v_edges USING (i, j) GROUP BY 1, 2, 3""")
def _(t):
    return st.top_edges(st.edge_anova(t.edges), t.edges, 20, [0, 1, 2], only_significant=False)


_RANK_SRC = "(SELECT i, j, label, round(w, 2) AS value FROM v_edges)"


def _rank_rows(t):
    return t.edges.select("i", "j", "label", F.round("w", 2).alias("value"))


@query("sta10_kruskal", "i:i j:i n:i h_stat:d", f"""
    WITH r AS (SELECT *, rank() OVER (PARTITION BY i, j ORDER BY value) + (count(*) OVER (PARTITION BY i, j, value) - 1) / 2 AS r FROM {_RANK_SRC}),
    t AS (SELECT i, j, sum(CAST(c AS DOUBLE) * c * c - c) AS t, sum(c) AS n FROM (SELECT i, j, value, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2),
    g AS (SELECT i, j, sum(s * s / c) AS q FROM (SELECT i, j, label, sum(r) AS s, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT i, j, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (CAST(n AS DOUBLE) * n * n - n)) AS h_stat FROM t JOIN g USING (i, j)""")
def _(t):
    return st.kruskal(st.class_ties(_rank_rows(t), ["i", "j"], [0, 1, 2]), ["i", "j"], [0, 1, 2])


@query("sta11_mann_whitney", "i:i j:i class_a:i class_b:i n1:i n2:i u_stat:d z_stat:d", f"""
    WITH p AS (SELECT * FROM (VALUES (0, 1), (0, 2), (1, 2)) p(class_a, class_b)),
    x AS (SELECT i, j, class_a, class_b, value, label = class_a AS first FROM {_RANK_SRC}, p WHERE label IN (class_a, class_b)),
    r AS (SELECT *, rank() OVER (PARTITION BY i, j, class_a, class_b ORDER BY value) + (count(*) OVER (PARTITION BY i, j, class_a, class_b, value) - 1) / 2 AS r FROM x),
    t AS (SELECT i, j, class_a, class_b, sum(CAST(c AS DOUBLE) * c * c - c) AS t FROM (SELECT i, j, class_a, class_b, value, count(*) AS c FROM x GROUP BY ALL) GROUP BY 1, 2, 3, 4),
    u AS (SELECT i, j, class_a, class_b, count(*) FILTER (WHERE first) AS n1, count(*) FILTER (WHERE NOT first) AS n2, sum(r) FILTER (WHERE first) AS rs FROM r GROUP BY 1, 2, 3, 4)
    SELECT *, (greatest(u_stat, n1 * n2 - u_stat) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z_stat
    FROM (SELECT *, rs - n1 * (n1 + 1) / 2 AS u_stat FROM u JOIN t USING (i, j, class_a, class_b))""")
def _(t):
    return st.mann_whitney(st.class_ties(_rank_rows(t), ["i", "j"], [0, 1, 2]), ["i", "j"], [(0, 1), (0, 2), (1, 2)])


_NORM = """(SELECT s.subject_id, s.i, s.j, s.m AS mean_adj, (s.m - mu) / sigma AS z_score FROM (SELECT subject_id, i, j, avg(w) AS m FROM v_edges GROUP BY 1, 2, 3) s
    JOIN (SELECT i, j, avg(m) AS mu, greatest(stddev_samp(m), 1e-8) AS sigma FROM (SELECT subject_id, i, j, avg(w) AS m FROM v_edges WHERE label = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (i, j))"""


@query("sta12_normative_z", "subject_id:i i:i j:i mean_adj:d z_score:d", f"SELECT * FROM {_NORM}")
def _(t):
    return st.normative_scores(*st.normative(t.edges, F.col("subject_id") % 3 == 0))


@query("sta12_normative_mask", "subject_id:i i:i j:i z_score:d p_val:d significant:b")
def _(t):
    return st.normative_scores(*st.normative(t.edges, F.col("subject_id") % 3 == 0))


@query("sta13_bootstrap_width", "subject_id:i i:i j:i ci_width:d stable:b", """
    WITH g AS (SELECT subject_id, segment_id, row_number() OVER (PARTITION BY subject_id ORDER BY segment_id) - 1 AS p, count(*) OVER (PARTITION BY subject_id) AS t FROM v_graphs),
    d AS (SELECT subject_id, b, t, CAST(floor(CAST('0x' || substr(md5(concat_ws('|', 0, subject_id, b, d)), 1, 13) AS BIGINT) / 4503599627370496.0 * t) AS BIGINT) AS p
      FROM (SELECT subject_id, t, unnest(range(t)) AS d FROM (SELECT DISTINCT subject_id, t FROM g)), range(200) r(b)),
    m AS (SELECT d.subject_id, b, i, j, sum(w) / min(t) AS m FROM d JOIN g USING (subject_id, p, t) JOIN v_edges e ON e.subject_id = d.subject_id AND e.segment_id = g.segment_id GROUP BY 1, 2, 3, 4),
    c AS (SELECT subject_id, i, j, quantile_cont(m, 0.975) - quantile_cont(m, 0.025) AS ci_width FROM m GROUP BY 1, 2, 3)
    SELECT *, ci_width <= quantile_cont(ci_width, 0.3) OVER (PARTITION BY subject_id) AS stable FROM c""")
def _(t):
    return st.stable_edges(st.bootstrap_widths(t.edges, draws=200))


@query("sta14_subject_standardize", "graph_id:i channel:i feature:i value:d", """
    SELECT graph_id, node AS channel, feature, (x - avg(x) OVER w) / greatest(stddev_samp(x) OVER w, 1e-8) AS value FROM v_nodes WINDOW w AS (PARTITION BY subject_id, node, feature)""")
def _(t):
    return prj.standardize_subject(t.nodes.select("graph_id", "subject_id", F.col("node").alias("channel"), "feature", F.col("x").alias("value")))


@query("sta15_dataset_summary", "num_subjects:i num_labels:i num_rates:i min_num_channels:i max_num_channels:i mean_num_channels:d min_duration_sec:d max_duration_sec:d mean_duration_sec:d", """
    SELECT count(*) AS num_subjects, count(DISTINCT subject_id % 3) AS num_labels, 1 AS num_rates, min(c) AS min_num_channels, max(c) AS max_num_channels, avg(c) AS mean_num_channels,
      min(n / 8) AS min_duration_sec, max(n / 8) AS max_duration_sec, avg(n / 8) AS mean_duration_sec FROM (SELECT subject_id, count(DISTINCT channel) AS c, min(n) AS n FROM v_samples GROUP BY 1)""")
def _(t):
    return st.dataset_summary(st.dataset_rows(t.recordings))


@query("sta15_label_counts", "label:i n_subjects:i n_segments:i min_segments:i max_segments:i mean_segments:d", """
    SELECT label, count(*) AS n_subjects, sum(n) AS n_segments, min(n) AS min_segments, max(n) AS max_segments, avg(n) AS mean_segments FROM (SELECT label, subject_id, count(*) AS n FROM v_graphs GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return st.label_counts(t.graphs)


@query("sta16_channel_similarity", "label:i i:i j:i corr:d", """
    WITH m AS (SELECT label, node, feature, avg(x) AS x FROM v_nodes GROUP BY 1, 2, 3)
    SELECT a.label, a.node AS i, b.node AS j, corr(a.x, b.x) AS corr FROM m a JOIN m b ON a.label = b.label AND a.feature = b.feature AND a.node < b.node GROUP BY 1, 2, 3""")
def _(t):
    return st.channel_similarity(t.nodes)
