"""Queries for noise scores, manifests and choices of windows (QC06-QC34)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import selection as sel
from .registry import query
from .signal_queries import WCH
from .views import FS

SS = "subject_id:i segment_id:i"
SR = "subject_id:i segment_id:i selected_rank:i"


def md5(*parts):
    return f"md5(concat_ws('|', {', '.join(str(p) for p in parts)}))"


def unit(*parts):
    return f"(CAST('0x' || substr({md5(*parts)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


H42, H0 = md5(42, "subject_id", "segment_id"), md5(0, "subject_id", "segment_id")


def pick(order, k, src="v_manifest", by="subject_id", rank="selected_rank"):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS {rank} FROM {src}) WHERE {rank} <= {k}"


def _cols(t, *names):
    """The manifest with the columns that a choice reads: the thinning step passes every column on."""
    return t.manifest.select("subject_id", "segment_id", *names)


def robust_sql(src, keys, value, positive=True):
    """z per row of ``src``; keys and rows pass through."""
    z = f"CASE WHEN sc < 1e-8 THEN 0 ELSE ({value} - med) / sc END"
    return f"""SELECT *, {f'greatest({z}, 0)' if positive else z} AS z FROM (SELECT *, CASE WHEN mad < 1e-8 THEN CASE WHEN q3 - q1 > 1e-8 THEN (q3 - q1) / 1.349 ELSE sd END ELSE 1.4826 * mad END AS sc FROM (
      SELECT *, median(abs({value} - med)) OVER (PARTITION BY {keys}) AS mad FROM (SELECT *, median({value}) OVER w AS med, quantile_cont({value}, 0.25) OVER w AS q1, quantile_cont({value}, 0.75) OVER w AS q3,
        stddev_pop({value}) OVER w AS sd FROM {src} WINDOW w AS (PARTITION BY {keys}))))"""


@query("qc06_robust_zscore", "subject_id:i segment_id:i z:d", robust_sql("v_manifest", "subject_id", "distance", False))
def _(t):
    return sel.robust_zscore(t.manifest, ["subject_id"], "distance")


@query("qc07_mad_threshold", "subject_id:i threshold:d", """
    SELECT subject_id, CASE WHEN mad < 1e-8 THEN q3 + 1.5 * (q3 - q1) ELSE med + 3.5 * 1.4826 * mad END AS threshold FROM (
      SELECT subject_id, min(med) AS med, min(q1) AS q1, min(q3) AS q3, median(abs(sampling_weight - med)) AS mad FROM (SELECT *, median(sampling_weight) OVER w AS med,
        quantile_cont(sampling_weight, 0.25) OVER w AS q1, quantile_cont(sampling_weight, 0.75) OVER w AS q3 FROM v_manifest WINDOW w AS (PARTITION BY subject_id)) GROUP BY 1)""")
def _(t):
    return sel.mad_threshold(t.manifest, ["subject_id"], "sampling_weight")


_CN = """(WITH thr AS (SELECT subject_id, quantile_cont(abs(w), 0.95) AS thr FROM v_edges GROUP BY 1), med AS (SELECT subject_id, i, j, median(w) AS med FROM v_edges GROUP BY 1, 2, 3),
    g AS (SELECT subject_id, segment_id, avg(w) AS conn_mean, stddev_pop(w) AS conn_std, avg(abs(w)) AS conn_abs_mean, max(abs(w)) AS conn_abs_max, avg(CASE WHEN abs(w) >= thr THEN 1.0 ELSE 0 END) AS conn_high_edge_fraction,
      sqrt(avg(pow(w - med, 2))) AS conn_median_distance FROM v_edges JOIN thr USING (subject_id) JOIN med USING (subject_id, i, j) GROUP BY 1, 2),
    d AS (SELECT a.subject_id, a.segment_id AS s, sqrt(avg(pow(a.w - b.w, 2))) AS d FROM v_edges a JOIN v_edges b ON a.subject_id = b.subject_id AND b.segment_id = a.segment_id + 1 AND a.i = b.i AND a.j = b.j GROUP BY 1, 2),
    j AS (SELECT subject_id, segment_id, avg(d) AS conn_temporal_jump FROM (SELECT subject_id, s AS segment_id, d FROM d UNION ALL SELECT subject_id, s + 1, d FROM d) GROUP BY 1, 2)
    SELECT g.*, coalesce(conn_temporal_jump, 0) AS conn_temporal_jump FROM g LEFT JOIN j USING (subject_id, segment_id))"""
_CCOLS = "conn_mean:d conn_std:d conn_abs_mean:d conn_abs_max:d conn_high_edge_fraction:d conn_median_distance:d conn_temporal_jump:d"


@query("qc08_connectivity_noise", f"{SS} {_CCOLS}", f"SELECT * FROM {_CN}")
def _(t):
    return sel.connectivity_noise(t.edges)


_NOISE_SRC = f"(SELECT c.*, n.ptp, n.abs_kurtosis FROM {_CN} c JOIN (SELECT subject_id, segment_id, max(x) - min(x) AS ptp, stddev_pop(x) AS abs_kurtosis FROM v_nodes GROUP BY 1, 2) n USING (subject_id, segment_id))"


@query("qc09_noise_scores", f"{SS} node_noise_score:d connectivity_noise_score:d combined_noise_score:d sampling_weight:d", f"""
    WITH l AS (UNPIVOT {_NOISE_SRC} ON ptp, abs_kurtosis, conn_std, conn_abs_max, conn_high_edge_fraction, conn_median_distance, conn_temporal_jump INTO NAME metric VALUE value),
    s AS (SELECT subject_id, segment_id, avg(z) FILTER (WHERE metric IN ('ptp', 'abs_kurtosis')) AS node_noise_score, avg(z) FILTER (WHERE metric LIKE 'conn%') AS connectivity_noise_score
      FROM ({robust_sql('l', 'subject_id, metric', 'value')}) GROUP BY 1, 2)
    SELECT *, 0.4 * node_noise_score + 0.6 * connectivity_noise_score AS combined_noise_score,
      least(greatest(exp(-(0.4 * node_noise_score + 0.6 * connectivity_noise_score) / 2), 0.05), 1) AS sampling_weight FROM s""")
def _(t):
    n = t.nodes.groupBy("subject_id", "segment_id").agg((F.max("x") - F.min("x")).alias("ptp"), F.stddev_pop("x").alias("abs_kurtosis"))
    w = sel.connectivity_noise(t.edges).join(n, ["subject_id", "segment_id"])
    return sel.noise_scores(w, node=["ptp", "abs_kurtosis"], node_weight=0.4, conn_weight=0.6, temperature=2.0)


def _window_scores(t):
    w = ft.hjorth(ft.time_stats(t.windows, fisher=True))
    return sel.window_scores(w)


@query("qc10_anomaly_labels", f"{SS} iforest_score:d4 iforest_is_clean:b")
def _(t):
    return sel.anomaly_labels(_window_scores(t), ["ptp", "abs_kurtosis", "hjorth_complexity"])


@query("qc11_window_scores", f"{SS} ptp:d9 kurtosis:d hjorth_complexity:d abs_kurtosis:d", f"""
    SELECT subject_id, segment_id, avg(ptp) AS ptp, avg(ku) AS kurtosis, avg(sqrt(v2 / v1) / sqrt(v1 / v0)) AS hjorth_complexity, abs(avg(ku)) AS abs_kurtosis FROM (
      SELECT {WCH}, max(value) - min(value) AS ptp, kurtosis(value) AS ku, var_pop(value) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM (
        SELECT *, d - lag(d) OVER (PARTITION BY {WCH} ORDER BY k) AS dd FROM (SELECT *, value - lag(value) OVER (PARTITION BY {WCH} ORDER BY k) AS d FROM v_windows)) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return _window_scores(t)


@query("qc11_window_state", f"{SS} cluster:i distance:d4")
def _(t):
    from .views import BANDS8

    p = ft.band_power(ft.welch_psd(t.windows, FS), BANDS8)
    v = p.groupBy("subject_id", "segment_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("channel", "relative"))), lambda s: s["relative"])).alias("spectral"))
    return sel.window_state(v)


@query("qc12_random", SR, pick(f"{H0}, segment_id", 10))
def _(t):
    return sel.select_random(_cols(t), 10)


@query("qc12_clean_first", SR, pick(f"CASE WHEN keep_clean THEN 0 ELSE 1 END, CASE WHEN keep_clean THEN {H0} END, CASE WHEN NOT keep_clean THEN score END DESC, segment_id", 450))
def _(t):
    return sel.select_clean_first(_cols(t, "keep_clean", "score"), 450)


_REP = "SELECT *, row_number() OVER (PARTITION BY subject_id, cluster ORDER BY {order}, segment_id) AS rc FROM {src}"


@query("qc12_diverse", SR, pick(f"CASE WHEN rc = 1 THEN 0 ELSE 1 END, CASE WHEN rc = 1 THEN cluster END, {H0}, segment_id", 10, f"({_REP.format(order='distance', src='v_manifest')})"))
def _(t):
    return sel.select_diverse(_cols(t, "cluster", "distance"), 10)


def _selected(t):
    m = _cols(t, "cluster", "distance", F.col("distance").alias("ptp"))
    return sel.select_random(m, 5).withColumn("method", F.lit("random")).unionByName(sel.select_diverse(m, 5).withColumn("method", F.lit("diverse")))


_SELECTED = f"""(SELECT subject_id, segment_id, cluster, distance, selected_rank, 'random' AS method FROM ({pick(f'{H0}, segment_id', 5)}) UNION ALL SELECT subject_id, segment_id, cluster, distance, selected_rank, 'diverse'
    FROM ({pick(f"CASE WHEN rc = 1 THEN 0 ELSE 1 END, CASE WHEN rc = 1 THEN cluster END, {H0}, segment_id", 5, f"({_REP.format(order='distance', src='v_manifest')})")}))"""
_COV = f"""(SELECT subject_id, method, count(*) AS num_selected, 100.0 * count(DISTINCT cluster) / 5 AS cluster_coverage_pct, avg(distance) AS mean_ptp, string_agg(segment_id, ',' ORDER BY selected_rank) AS segment_ids FROM {_SELECTED} GROUP BY 1, 2)"""


@query("qc13_coverage", "subject_id:i method:s num_selected:i cluster_coverage_pct:d mean_ptp:d9 segment_ids:s", f"SELECT * FROM {_COV}")
def _(t):
    return sel.coverage(_selected(t), 6, 5)


@query("qc13_coverage_by_method", "method:s cluster_coverage_pct:d mean_ptp:d", f"SELECT method, avg(cluster_coverage_pct) AS cluster_coverage_pct, avg(mean_ptp) AS mean_ptp FROM {_COV} GROUP BY 1")
def _(t):
    return sel.coverage_by_method(sel.coverage(_selected(t), 6, 5), ["cluster_coverage_pct", "mean_ptp"])


def _diag(t):
    m = t.manifest.withColumn("ptp", F.col("distance")).withColumn("abs_kurtosis", F.col("sampling_weight"))
    return sel.cluster_diagnostics(m, clean="keep_clean")


_DIAG = """(SELECT *, cluster_size / sum(cluster_size) OVER (PARTITION BY subject_id) AS cluster_fraction FROM (SELECT label, subject_id, cluster, count(*) AS cluster_size, avg(distance) AS mean_ptp, median(distance) AS median_ptp,
    avg(sampling_weight) AS mean_abs_kurtosis, avg(CASE WHEN keep_clean THEN 0.0 ELSE 1.0 END) AS anomaly_fraction FROM v_manifest GROUP BY 1, 2, 3))"""
_FLAGGED = f"(SELECT *, anomaly_fraction >= 0.4 OR (mean_ptp >= quantile_cont(mean_ptp, 0.75) OVER () AND mean_abs_kurtosis >= quantile_cont(mean_abs_kurtosis, 0.75) OVER ()) AS artifact_like_cluster FROM {_DIAG})"


@query("qc14_cluster_diagnostics", "subject_id:i cluster:i cluster_size:i cluster_fraction:d mean_ptp:d median_ptp:d9 mean_abs_kurtosis:d anomaly_fraction:d artifact_like_cluster:b", f"SELECT * FROM {_FLAGGED}")
def _(t):
    return sel.flag_clusters(_diag(t), anomaly=0.4)


@query("qc14_class_rollup", "label:i artifact_like_cluster_fraction:d artifact_segment_fraction:d", f"""
    SELECT label, avg(a) AS artifact_like_cluster_fraction, avg(b) AS artifact_segment_fraction FROM (SELECT label, subject_id, avg(artifact_like_cluster::INT) AS a,
      sum(CASE WHEN artifact_like_cluster THEN cluster_size ELSE 0 END) / sum(cluster_size) AS b FROM {_FLAGGED} GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return sel.cluster_rollup(sel.flag_clusters(_diag(t), anomaly=0.4))[1]


def _manifest(t):
    return sel.clean_manifest(t.manifest.drop("keep_clean"), _diag(t), anomaly=0.35, min_size=2)


_MAN = f"(SELECT m.* EXCLUDE (keep_clean), cluster_size, cluster_fraction, anomaly_fraction AS cluster_anomaly_fraction, anomaly_fraction >= 0.35 AND cluster_size >= 2 AS artifact_cluster, NOT (anomaly_fraction >= 0.35 AND cluster_size >= 2) AS keep_clean FROM v_manifest m JOIN {_DIAG} d USING (subject_id, cluster))"


@query("qc15_clean_manifest", f"{SS} cluster:i cluster_size:i cluster_fraction:d cluster_anomaly_fraction:d artifact_cluster:b keep_clean:b", f"SELECT * FROM {_MAN}")
def _(t):
    return _manifest(t)


_BYSUB = f"""(SELECT split, label, subject_id, count(*) AS num_segments_total, count(*) FILTER (WHERE keep_clean) AS num_segments_clean, count(*) FILTER (WHERE NOT keep_clean) AS num_segments_removed,
    avg((NOT keep_clean)::INT) AS removed_fraction, count(DISTINCT cluster) AS num_clusters_total, count(DISTINCT CASE WHEN artifact_cluster THEN cluster END) AS num_artifact_clusters, avg(distance) AS mean_distance_all,
    avg(distance) FILTER (WHERE keep_clean) AS mean_distance_clean, avg(distance) FILTER (WHERE NOT keep_clean) AS mean_distance_removed FROM {_MAN} WHERE subject_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3)"""


def _by_subject(t):
    deny = t.table("supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("subject_id"))
    return sel.manifest_by_subject(_manifest(t), ["distance"], deny=deny)


@query("qc16_manifest_by_subject", "subject_id:i num_segments_total:i num_segments_clean:i num_segments_removed:i removed_fraction:d9 num_clusters_total:i num_artifact_clusters:i mean_distance_all:d10 mean_distance_clean:d10 mean_distance_removed:d10", f"SELECT * FROM {_BYSUB}")
def _(t):
    return _by_subject(t)


@query("qc16_manifest_by_class", "split:s label:i num_segments_total:d removed_fraction:d mean_distance_clean:d", f"""
    SELECT split, label, avg(num_segments_total) AS num_segments_total, avg(removed_fraction) AS removed_fraction, avg(mean_distance_clean) AS mean_distance_clean FROM {_BYSUB} GROUP BY 1, 2""")
def _(t):
    return sel.manifest_by_class(_by_subject(t))


@query("qc16_too_few_clean", "subject_id:i num_segments_clean:i", f"SELECT * FROM {_BYSUB} WHERE num_segments_clean < 500")
def _(t):
    return sel.too_few_clean(_by_subject(t), 500)


@query("qc17_weight_summary", "subject_id:i label:i num_segments:i weight_min:d weight_q25:d weight_median:d weight_mean:d weight_q75:d weight_max:d weight_std:d effective_sample_size:d effective_fraction:d", """
    SELECT *, effective_sample_size / num_segments AS effective_fraction FROM (SELECT subject_id, min(label) AS label, count(*) AS num_segments, min(sampling_weight) AS weight_min, quantile_cont(sampling_weight, 0.25) AS weight_q25,
      median(sampling_weight) AS weight_median, avg(sampling_weight) AS weight_mean, quantile_cont(sampling_weight, 0.75) AS weight_q75, max(sampling_weight) AS weight_max, stddev_pop(sampling_weight) AS weight_std,
      pow(sum(sampling_weight), 2) / sum(sampling_weight * sampling_weight) AS effective_sample_size FROM v_manifest WHERE keep_clean GROUP BY 1)""")
def _(t):
    return sel.weight_summary(t.manifest)


_TOPW = pick("sampling_weight DESC, segment_id", 10, "(SELECT * FROM v_manifest WHERE keep_clean)", rank="top_rank")


@query("qc18_top_weights", "subject_id:i segment_id:i sampling_weight:d top_rank:i", _TOPW)
def _(t):
    return sel.top_weights(_cols(t, "keep_clean", "sampling_weight", "label"))[0]


@query("qc18_top_weight_summary", "subject_id:i distance_mean:d9 distance_std:d9 distance_min:d9 distance_max:d9", f"""
    SELECT subject_id, avg(distance) AS distance_mean, stddev_samp(distance) AS distance_std, min(distance) AS distance_min, max(distance) AS distance_max FROM ({_TOPW}) GROUP BY 1""")
def _(t):
    return sel.top_weights(_cols(t, "keep_clean", "sampling_weight", "label", "distance"), metrics=["distance"])[1]


@query("qc19_keep_clean_filter", "subject_id:s segment_id:i", """
    SELECT CASE WHEN subject_id % 2 = 0 THEN split || '_' ELSE '' END || subject_id AS subject_id, segment_id FROM v_manifest WHERE keep_clean""")
def _(t):
    g = t.manifest.select(F.concat(F.when(F.col("subject_id") % 2 == 0, F.concat("split", F.lit("_"))).otherwise(""), "subject_id").alias("subject_id"), "segment_id")
    return sel.keep_clean_filter(g, t.manifest)


@query("qc20_noise_clusters", "cluster:i n:i clean_rate:d median_distance:d9 is_noise:b", """
    SELECT cluster, n, clean_rate, median_distance, n < 50 OR clean_rate < 0.66 OR median_distance > far AS is_noise FROM (SELECT cluster, count(*) AS n, avg(keep_clean::INT) AS clean_rate, median(distance) AS median_distance FROM v_manifest GROUP BY 1),
      (SELECT quantile_cont(distance, 0.95) AS far FROM v_manifest)""")
def _(t):
    return sel.noise_clusters(t.manifest, min_clean=0.66)


_BAL = pick(f"CASE WHEN rc = 1 THEN 0 ELSE 1 END, CASE WHEN rc = 1 THEN {md5(42, chr(39) + 'c' + chr(39), 'subject_id', 'cluster')} END, {H42}, segment_id", 10, f"({_REP.format(order=H42, src='v_manifest')})")


@query("qc21_cluster_balanced", SR, _BAL)
def _(t):
    return sel.cluster_balanced(_cols(t, "cluster"), 10)


_ALLOCATED = f"""(
    WITH RECURSIVE n AS MATERIALIZED (SELECT subject_id, cluster, count(*) AS n FROM v_manifest GROUP BY 1, 2),
    s AS MATERIALIZED (SELECT subject_id, list(cluster ORDER BY cluster) AS c, list(n ORDER BY cluster) AS n, list(0.95 * sqrt(n) / total + 0.05 / cells ORDER BY cluster) AS w
      FROM (SELECT *, sum(sqrt(n)) OVER (PARTITION BY subject_id) AS total, count(*) OVER (PARTITION BY subject_id) AS cells FROM n) GROUP BY 1),
    d(subject_id, slot, got) AS (SELECT subject_id, 0, list_transform(c, lambda x: 0) FROM s
      UNION ALL SELECT subject_id, slot + 1, CASE WHEN total > 0 THEN list_transform(range(1, len(got) + 1), lambda i: got[i] + CASE WHEN i = 1 + len(list_filter(run, lambda v: v <= u * total)) THEN 1 ELSE 0 END) ELSE got END
      FROM (SELECT *, run[len(run)] AS total FROM (SELECT *, list_transform(range(1, len(q) + 1), lambda i: list_sum(q[1:i])) AS run, {unit(42, "'slot'", 'subject_id', 'slot')} AS u
        FROM (SELECT *, CASE WHEN len(list_filter(open, lambda v: v > 0)) > 0 THEN open ELSE free END AS q
          FROM (SELECT *, list_transform(range(1, len(got) + 1), lambda i: CASE WHEN got[i] < n[i] AND got[i] < 6 THEN w[i] ELSE 0 END) AS open,
                       list_transform(range(1, len(got) + 1), lambda i: CASE WHEN got[i] < n[i] THEN w[i] ELSE 0 END) AS free FROM d JOIN s USING (subject_id) WHERE slot < 10)))))
    SELECT subject_id, unnest(c) AS cluster, unnest(n) AS n, unnest(got) AS allocated FROM d JOIN s USING (subject_id) WHERE slot = 10)"""


@query("qc22_cluster_allocation", "subject_id:i cluster:i n:i allocated:i", f"SELECT * FROM {_ALLOCATED}")
def _(t):
    return sel.allocate_clusters(t.manifest, 10)


@query("qc22_cluster_proportional", SR)
def _(t):
    return sel.cluster_proportional(_cols(t, "cluster", "sampling_weight"), 10, weight="sampling_weight")


@query("qc23_weighted_sample", SR, pick(f"ln({unit(42, 'subject_id', 'segment_id')}) / greatest(sampling_weight, 1e-8) DESC, segment_id", 10, "(SELECT * FROM v_manifest WHERE keep_clean)"))
def _(t):
    return sel.weighted_sample(_cols(t, "keep_clean", "sampling_weight"), 10)


@query("qc24_representative_scored", SR, pick("CASE WHEN rc = 1 THEN 0 ELSE 1 END, sampling_weight / (1 + distance) DESC, segment_id", 10, f"({_REP.format(order='sampling_weight / (1 + distance) DESC', src='v_manifest')})"))
def _(t):
    return sel.representative_scored(_cols(t, "cluster", "sampling_weight", "distance"), 10)


_CLEAN = "(SELECT *, count(*) OVER (PARTITION BY subject_id, cluster) AS cs FROM v_manifest WHERE keep_clean)"


@query("qc25_clean_kmeans", SR, pick(f"CASE WHEN rc = 1 THEN 0 ELSE 1 END, CASE WHEN rc = 1 THEN cs END DESC, CASE WHEN rc = 1 THEN cluster END, {H42}, segment_id", 10, f"({_REP.format(order='distance', src=_CLEAN)})"))
def _(t):
    return sel.clean_kmeans(_cols(t, "cluster", "keep_clean", "distance"), 10)


_TABLE = """(SELECT *, p AS p_, (SUM(-greatest(p, 1e-12) * log2(greatest(p, 1e-12))) OVER (PARTITION BY cluster)) / log2(3) AS h FROM (SELECT cluster, label, count(*) / sum(count(*)) OVER (PARTITION BY cluster) AS p FROM v_manifest GROUP BY 1, 2))"""
_HE = md5(42, 0, "subject_id", "segment_id")
_ALIGN_SRC = f"(SELECT m.*, p, h, count(*) OVER (PARTITION BY subject_id, m.cluster) AS ns FROM v_manifest m JOIN {_TABLE} c ON c.cluster = m.cluster AND c.label = m.label)"
_ALIGN_ORDER = f"p DESC, h, ns DESC, cluster, {_HE}, segment_id"


@query("qc26_label_aligned", SS, pick(_ALIGN_ORDER, 10, _ALIGN_SRC))
def _(t):
    return sel.label_aligned(_cols(t, "cluster", "label"), 10)


@query("qc26_mixed", SS, f"""
    WITH a AS ({pick(_ALIGN_ORDER, 5, _ALIGN_SRC, rank='ra')}),
    r AS ({pick(md5(42, chr(39) + 'r' + chr(39), 0, 'subject_id', 'segment_id') + ', segment_id', 5, '(SELECT * FROM v_manifest ANTI JOIN a USING (subject_id, segment_id))', rank='rr')})
    SELECT subject_id, segment_id FROM a UNION ALL SELECT subject_id, segment_id FROM r""")
def _(t):
    return sel.label_aligned(t.manifest, 10, random_share=0.5)


@query("qc26_cluster_label_table", "cluster:i label:i p:d entropy_norm:d", f"SELECT cluster, label, p, h AS entropy_norm FROM {_TABLE}")
def _(t):
    return sel.cluster_label_table(t.manifest)


@query("qc27_label_aware_k", "label:i n_subjects:i k:i", """
    SELECT label, n AS n_subjects, least(ceil(max(n) OVER () * 10 / n), 15) AS k FROM (SELECT true_label AS label, count(DISTINCT subject_id) AS n FROM v_preds GROUP BY 1)""")
def _(t):
    return sel.label_aware_k(t.preds.select("subject_id", F.col("true_label").alias("label")).distinct(), 10, 15)


def _bag_sql(order, k, src="(SELECT * FROM v_graphs, range(2) e(epoch))"):
    """Picks by rank, then ranks beyond the group's size drawn from its picks."""
    return f"""WITH p AS ({pick(order, k, src, 'epoch, subject_id')}), n AS (SELECT epoch, subject_id, count(*) AS n FROM p GROUP BY 1, 2),
      d AS (SELECT epoch, subject_id, r, CAST(floor({unit(42, chr(39) + 'up' + chr(39), 'epoch', 'subject_id', 'r')} * n) AS BIGINT) + 1 AS src FROM n, range(1, {k + 1}) q(r) WHERE r > n)
      SELECT epoch, subject_id, segment_id, selected_rank FROM p UNION ALL SELECT d.epoch, d.subject_id, p.segment_id, d.r FROM d JOIN p ON p.epoch = d.epoch AND p.subject_id = d.subject_id AND p.selected_rank = d.src"""


@query("qc28_bags_with_replacement", "epoch:i subject_id:i segment_id:i selected_rank:i", _bag_sql(f"{md5(42, 'epoch', 'subject_id', 'segment_id')}, segment_id", 100))
def _(t):
    return sel.bags(t.graphs.drop("nodes"), 100, epochs=2)


@query("qc28_bags_weighted", "epoch:i subject_id:i segment_id:i selected_rank:i", pick(f"ln({unit(42, 'epoch', 'subject_id', 'segment_id')}) / greatest(sampling_weight, 1e-8) DESC, segment_id", 10, "(SELECT * FROM v_manifest, range(3) e(epoch) WHERE keep_clean)", "epoch, subject_id"))
def _(t):
    return sel.bags(t.manifest, 10, epochs=3, strategy="weighted")


@query("qc29_pseudo_bags", "bag:i label:i slot:i subject_id:i segment_id:i")
def _(t):
    return sel.pseudo_bags(t.manifest, n_bags=200)


@query("qc29_bag_rules", "kind:s bags:i n_rows:i broken:i", "SELECT unnest(['class', 'cluster']) AS kind, 200 AS bags, 2000 AS n_rows, 0 AS broken")
def _(t):
    """Bags that break a rule: k slots once each, one label (and cluster), few subjects, only windows that exist and fit."""
    own = t.manifest.select("subject_id", "segment_id", "label", "cluster")
    out = None
    for kind, by, kw in (("class", [], {}), ("cluster", ["cluster"], {"cluster": "cluster", "min_segments": 30, "min_subjects": 2})):
        b = sel.pseudo_bags(t.manifest, n_bags=200, **kw)
        j = b.join(own.withColumn("_there", F.lit(1)), ["subject_id", "segment_id", "label", *by], "left")
        per = j.groupBy("bag").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count("_there").alias("there"),
                                   F.count_distinct("label", *by).alias("pools"))
        bad = F.when((F.col("n") == 10) & (F.col("slots") == 10) & (F.col("low") == 0) & (F.col("high") == 9) & (F.col("there") == 10) & (F.col("pools") == 1), 0).otherwise(1)
        one = per.agg(F.count("*").alias("bags"), F.sum("n").alias("n_rows"), F.sum(bad).alias("broken")).select(F.lit(kind).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("qc29_pseudo_bags_by_cluster", "bag:i label:i cluster:i slot:i subject_id:i segment_id:i")
def _(t):
    return sel.pseudo_bags(t.manifest, n_bags=200, cluster="cluster", min_segments=30, min_subjects=2)


_DRAWS = f"({pick(md5(42, 'epoch', 'subject_id', 'segment_id') + ', segment_id', 10, '(SELECT * FROM v_manifest, range(5) e(epoch))', 'epoch, subject_id')})"


def _draws(t):
    return sel.bags(t.manifest.select("subject_id", "segment_id", "cluster", "label"), 10, epochs=5)


@query("qc30_diversity_by_epoch", "epoch:i num_draws:i num_subjects:i unique_segments:i unique_clusters:i mean_bag_size:d unique_segment_ratio:d", f"""
    SELECT epoch, count(*) AS num_draws, count(DISTINCT subject_id) AS num_subjects, count(DISTINCT segment_id) AS unique_segments, count(DISTINCT cluster) AS unique_clusters, count(*) / count(DISTINCT subject_id) AS mean_bag_size,
      count(DISTINCT segment_id) / count(*) AS unique_segment_ratio FROM {_DRAWS} GROUP BY 1""")
def _(t):
    return sel.diversity(_draws(t))[0]


@query("qc30_diversity_global", "probe_epochs:i num_subjects:i total_draws:i unique_segments_total:i unique_clusters_total:i mean_subject_unique_segment_ratio:d", f"""
    SELECT count(DISTINCT epoch) AS probe_epochs, count(DISTINCT subject_id) AS num_subjects, count(*) AS total_draws, count(DISTINCT (subject_id, segment_id)) AS unique_segments_total, count(DISTINCT cluster) AS unique_clusters_total,
      (SELECT avg(r) FROM (SELECT count(DISTINCT segment_id) / count(*) AS r FROM {_DRAWS} GROUP BY subject_id)) AS mean_subject_unique_segment_ratio FROM {_DRAWS}""")
def _(t):
    return sel.diversity(_draws(t))[2]


def _subjects(t):
    return t.preds.select("subject_id", F.col("true_label").alias("label")).distinct()


_FOLD = f"""(WITH s AS (SELECT DISTINCT subject_id, true_label AS label FROM v_preds),
    f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {md5(42, 'subject_id')}, subject_id) - 1) % 5 AS test_fold FROM s),
    r AS (SELECT fold, subject_id, label, row_number() OVER (PARTITION BY fold, label ORDER BY {md5(42, chr(39) + 'val' + chr(39), 'fold', 'subject_id')}, subject_id) - 1 AS q, count(*) OVER (PARTITION BY fold, label) AS n
      FROM f, range(5) k(fold) WHERE test_fold <> fold)
    SELECT test_fold AS fold, subject_id, label, 'test' AS role FROM f UNION ALL SELECT fold, subject_id, label, CASE WHEN q < round(n * 0.2) THEN 'val' ELSE 'train' END FROM r)"""


@query("qc31_stratified_folds", "fold:i subject_id:i label:i role:s", f"SELECT * FROM {_FOLD}")
def _(t):
    return sel.stratified_folds(_subjects(t), 5)


@query("qc32_split_records", "fold:i role:s n:i subjects:i", f"SELECT f.fold, role, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM v_preds JOIN {_FOLD} f USING (subject_id) GROUP BY 1, 2")
def _(t):
    r = sel.split_records(t.preds.select("subject_id", "instance_id"), sel.stratified_folds(_subjects(t), 5))
    return r.groupBy("fold", "role").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


@query("qc33_first_per_subject", "subject_id:i segment_id:i start_sample:i", "SELECT subject_id, segment_id, start_sample FROM v_graphs WHERE segment_id = 0")
def _(t):
    return sel.first_per_subject(t.graphs)


@query("qc34_strategy_dispatch", "strategy:s subject_id:i segment_id:i", f"""
    WITH m AS MATERIALIZED (SELECT subject_id, segment_id, keep_clean, sampling_weight, {unit(7, 'subject_id', 'segment_id')} AS u, {md5(7, 'subject_id', 'segment_id')} AS h FROM v_manifest)
    SELECT 'weighted_k' AS strategy, subject_id, segment_id FROM ({pick("ln(u) / greatest(sampling_weight, 1e-8) DESC, segment_id", 4, "(SELECT * FROM m WHERE keep_clean)")})
    UNION ALL SELECT 'random_k', subject_id, segment_id FROM ({pick("h, segment_id", 4, "m")})
    UNION ALL SELECT 'keep_clean', subject_id, segment_id FROM m WHERE keep_clean""")
def _(t):
    out = None
    for s in ("weighted_k", "random_k", "keep_clean"):
        d = sel.select(_cols(t, "keep_clean", "sampling_weight"), s, 4, 7).select(F.lit(s).alias("strategy"), "subject_id", "segment_id")
        out = d if out is None else out.unionByName(d)
    return out

