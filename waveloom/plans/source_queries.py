"""Queries for sources and sinks (SRC) and the user function surface (UDF)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import connectivity as con
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import projections as prj
from ..operators import recordings as rec
from ..operators.landing import shared_dir
from ..sources import logs, manifests, records, results, store
from .connect_queries import corr_sql
from .evaluate_queries import FOLDS, fold_metrics
from .registry import query
from .views import FS


def scratch(t, name):
    return f"{shared_dir(t.spark)}/waveloom/{t.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("src01_recordings", "subject_id:i n_channels:i n_samples:i label_id:i", """
    SELECT subject_id, count(DISTINCT channel) AS n_channels, min(n) AS n_samples, subject_id % 3 AS label_id FROM v_samples
    WHERE subject_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1 ORDER BY subject_id LIMIT 10""")
def _(t):
    ids = t.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("subject_id"))
    return records.choose_recordings(t.recordings, ids, 10).withColumn("n_channels", F.size("channels"))


@query("src01_all_recordings", "subject_id:i n_channels:i n_samples:i label_id:i", """
    SELECT subject_id, count(DISTINCT channel) AS n_channels, min(n) AS n_samples, subject_id % 3 AS label_id FROM v_samples
    WHERE subject_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1""")
def _(t):
    ids = t.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("subject_id"))
    return records.choose_recordings(t.recordings, ids).withColumn("n_channels", F.size("channels"))


@query("src01_recording_files", "subject_id:s n:i", "SELECT 'sub-' || c_nationkey AS subject_id, 1 AS n FROM customer GROUP BY 1")
def _(t):
    root = scratch(t, "files")
    t.table("customer").select(F.concat(F.lit("sub-"), "c_nationkey").alias("subject"), "c_custkey").repartition("subject").write.partitionBy("subject").parquet(root)
    f = records.list_files(t.spark, root, "*.parquet")
    return f.groupBy("subject_id").agg(F.count("*").alias("n"))


_CODE = "CASE c_nationkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'F' ELSE 'X' END"


@query("src02_participant_labels", "participant_id:s label:i task:s", f"""
    WITH p AS (SELECT 'sub-' || c_custkey AS participant_id, {_CODE} AS g FROM customer WHERE c_custkey <> 86)
    SELECT participant_id, CASE g WHEN 'C' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS label, 'all3' AS task FROM p WHERE g <> 'X'
    UNION ALL SELECT participant_id, CASE g WHEN 'A' THEN 1 ELSE 0 END, 'adftd' FROM p WHERE g IN ('A', 'F')""")
def _(t):
    path = scratch(t, "participants")
    k = F.col("c_nationkey") % 4
    g = F.when(k == 0, "A").when(k == 1, "C").when(k == 2, "F").otherwise("X")
    t.table("customer").select(F.concat(F.lit("sub-"), "c_custkey").alias("participant_id"), g.alias("Group")).write.option("sep", "\t").option("header", "true").csv(path)
    p = records.read_participants(t.spark, path)
    out = [records.group_labels(p, task, deny=["sub-86"]).withColumn("task", F.lit(task)) for task in ("all3", "adftd")]
    return out[0].unionByName(out[1])


@query("src03_symptom_labels", "serial:s label:i class_name:s", """
    SELECT lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(5, length(CAST(p_partkey AS VARCHAR))) AS INT), '0') AS serial, CASE WHEN s1 IN ('normal', 'smi') OR s2 = 'smi' THEN 0 WHEN s1 = 'ad' THEN 1 WHEN s2 = 'mci' THEN 2 END AS label,
      CASE WHEN s1 IN ('normal', 'smi') OR s2 = 'smi' THEN 'Healthy' WHEN s1 = 'ad' THEN 'Dementia' WHEN s2 = 'mci' THEN 'MCI' END AS class_name
    FROM (SELECT p_partkey, list_extract(['normal', 'ad', 'other'], CAST(p_size % 3 + 1 AS INT)) AS s1, list_extract(['mci', 'smi', 'none', 'x'], CAST(p_partkey % 4 + 1 AS INT)) AS s2 FROM part) WHERE label IS NOT NULL""")
def _(t):
    path = scratch(t, "annotations")
    s1 = F.element_at(F.array(F.lit("Normal"), F.lit("AD"), F.lit("other")), (F.col("p_size") % 3 + 1).cast("int"))
    s2 = F.element_at(F.array(F.lit("mci"), F.lit("SMI"), F.lit("none"), F.lit("x")), (F.col("p_partkey") % 4 + 1).cast("int"))
    # index documents of a few parts each, as a large data set has many
    group = F.floor(F.col("p_partkey") / 50)
    t.table("part").groupBy(group.alias("g")).agg(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("serial"), F.array(s1, s2).alias("symptom"))).alias("data")).select("data").write.json(path)
    return records.symptom_labels(t.spark.read.schema("data array<struct<serial:string,symptom:array<string>>>").json(path).select(F.explode("data").alias("d")).select("d.serial", "d.symptom"))


_STORED = "CASE WHEN c_custkey % 2 = 0 THEN CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END || '_' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END"
_SPLIT = "CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END"


def _serials(t):
    k = F.col("c_custkey")
    split = F.when(k % 5 == 0, "test").when(k % 5 == 1, "val").otherwise("train")
    c = t.table("customer").select("c_custkey", "c_acctbal", split.alias("split"), k.cast("string").alias("serial"))
    stored = c.filter("c_acctbal > 0").select(F.when(F.col("c_custkey") % 2 == 0, F.concat_ws("_", "split", "serial")).otherwise(F.col("serial")).alias("subject_id"))
    bad = t.table("supplier").select(F.col("s_suppkey").cast("string").alias("serial")).filter("serial % 7 = 0")
    return records.resolve_official(c.select("split", "serial"), stored, bad)


@query("src04_official_split", "split:s serial:s subject_id:s", f"SELECT {_SPLIT} AS split, CAST(c_custkey AS VARCHAR) AS serial, {_STORED} AS subject_id FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0)")
def _(t):
    return _serials(t)[0]


@query("src04_missing_serials", "split:s serial:s", f"SELECT {_SPLIT} AS split, CAST(c_custkey AS VARCHAR) AS serial FROM customer WHERE NOT c_acctbal > 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 0)")
def _(t):
    return _serials(t)[1]


def _features(t):
    s = ft.time_stats(t.windows)
    cells = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(n).alias("feature"), F.col(n).alias("value")) for f, n in (("level", "mean"), ("level", "std"), ("range", "ptp"))])
    return s.select("subject_id", "segment_id", "channel", F.explode(cells).alias("f")).select("subject_id", "segment_id", "channel", "f.*")


_LONG = "(SELECT subject_id, segment_id, channel, u.family, u.feature, u.value FROM (SELECT subject_id, segment_id, channel, avg(value) AS a, stddev_pop(value) AS b, max(value) - min(value) AS c FROM v_windows GROUP BY 1, 2, 3), LATERAL (VALUES ('level', 'mean', a), ('level', 'std', b), ('range', 'ptp', c)) u(family, feature, value))"


def _edges(t):
    e = con.pearson(t.windows).withColumn("band", F.explode(F.array(F.lit("low"), F.lit("high"))))
    return e.withColumn("value", F.when(F.col("band") == "low", F.col("value")).otherwise(-F.col("value")))


_PEARSON = f"(SELECT a.subject_id, a.segment_id, a.channel AS i, b.channel AS j, {corr_sql('a.value', 'b.value')} AS value FROM v_windows a JOIN v_windows b ON a.subject_id = b.subject_id AND a.segment_id = b.segment_id AND a.k = b.k AND a.channel < b.channel GROUP BY 1, 2, 3, 4)"


@query("src05_store_write_resume", "subject_id:i family:s n:i total:d4", f"SELECT subject_id, family, count(*) AS n, sum(value) AS total FROM {_LONG} GROUP BY 1, 2")
def _(t):
    path = scratch(t, "store")
    f, w = _features(t), t.window_index
    # a first run that stored the even subjects, then a resumed run over all
    store.write_store(path, {"windows": w.filter("subject_id % 2 = 0"), "features": f.filter("subject_id % 2 = 0")})
    store.write_store(path, {"windows": w, "features": f})
    return store.read_table(t.spark, path, "features").groupBy("subject_id", "family").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("src06_feature_family", "subject_id:i segment_id:i channel:s feature:s value:d9 bad_segment_flag:b", f"""
    SELECT f.*, b.subject_id IS NOT NULL AS bad_segment_flag FROM {_LONG} f LEFT JOIN (SELECT subject_id, segment_id FROM v_windows GROUP BY 1, 2 HAVING max(abs(value)) > 150) b ON b.subject_id = f.subject_id AND b.segment_id = f.segment_id
    WHERE family = 'range' AND f.subject_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def _(t):
    ids = t.table("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("subject_id"))
    bad = t.windows.groupBy("subject_id", "segment_id").agg(F.max(F.array_max(F.transform("x", F.abs))).alias("m")).filter("m > 150")
    return store.choose_features(_features(t), ["range"], subjects=ids, bad=bad)


@query("src07_connectivity_bands", "subject_id:i segment_id:i i:s j:s band:s band_index:i value:d", f"""
    SELECT *, 'high' AS band, 0 AS band_index FROM (SELECT subject_id, segment_id, i, j, -value AS value FROM {_PEARSON}) UNION ALL SELECT *, 'low', 1 FROM {_PEARSON}""")
def _(t):
    path = scratch(t, "conn")
    store.write_store(path, {"connectivity": _edges(t)})
    return store.read_connectivity(t.spark, path, "pearson", bands=["high", 0], band_names=["low", "high"])


@query("src08_inventory", "kind:s name:s n_subjects:i n_rows:i members:s", f"""
    SELECT 'features' AS kind, family AS name, count(DISTINCT subject_id) AS n_subjects, count(*) AS n_rows, string_agg(DISTINCT feature, ',' ORDER BY feature) AS members FROM {_LONG} GROUP BY 1, 2
    UNION ALL SELECT 'connectivity', 'pearson', count(DISTINCT subject_id), 2 * count(*), 'high,low' FROM {_PEARSON}""")
def _(t):
    return store.inventory(_features(t), _edges(t))


def _merged(t):
    m = t.manifest.select(F.concat_ws("_", "split", "subject_id").alias("subject_id"), "segment_id", "distance")
    return store.merge_stores(m, m.withColumn("distance", -F.col("distance")))


@query("src09_merge_stores", "subject_id:s segment_id:i distance:d9", "SELECT split || '_' || subject_id AS subject_id, segment_id, CASE WHEN split = 'train' THEN distance ELSE -distance END AS distance FROM v_manifest")
def _(t):
    return _merged(t)


@query("src09_merge_new_only", "subject_id:s segment_id:i distance:d9", "SELECT split || '_' || subject_id AS subject_id, segment_id, CASE WHEN split = 'train' THEN distance ELSE -distance END AS distance FROM v_manifest WHERE subject_id % 4 <> 0")
def _(t):
    m = t.manifest.withColumn("subject_id", F.concat_ws("_", "split", "subject_id"))
    have = t.manifest.filter("subject_id % 4 = 0").withColumn("subject_id", F.concat_ws("_", "split", "subject_id"))
    return store.merge_stores(m, m.withColumn("distance", -F.col("distance")), existing=have)


@query("src09_merge_report", "source:s split:s requested:i copied:i skipped_existing:i", """
    SELECT CASE WHEN split = 'train' THEN 'train_store' ELSE 'other_store' END AS source, split, count(*) AS requested, count(*) FILTER (WHERE subject_id % 7 <> 0) AS copied, count(*) FILTER (WHERE subject_id % 7 = 0) AS skipped_existing
    FROM (SELECT DISTINCT split, subject_id FROM v_manifest) GROUP BY 1, 2""")
def _(t):
    old = t.manifest.filter("subject_id % 7 = 0").select(F.concat_ws("_", "split", "subject_id").alias("subject_id"))
    return store.merge_report(_merged(t), old)


@query("src10_carry_forward", "conv_id:i turn:i marker:i role:s", """
    SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS marker, role FROM conversations""")
def _(t):
    c = t.table("conversations").select("conv_id", "turn", "role", F.when(F.col("role") == "user", F.col("turn")).alias("marker"))
    return logs.carry_forward(c, ["conv_id"], ["turn"], ["marker"])


def _log_files(t):
    """One log per variant, written from the fold metrics of the prediction table and read back as text."""
    path = scratch(t, "logs")
    cm = ev.confusion(t.preds, 3, ["fold", "variant"]).groupBy("fold", "variant").agg(F.sort_array(F.collect_list(F.struct("true_label", "pred_label", "count"))).alias("c"))
    n = lambda k: F.get("c", k)["count"].cast("string")
    f = fold_metrics(t).join(cm, ["fold", "variant"])
    block = lambda title: [F.lit(title), F.format_string("Accuracy: %.4f", "accuracy"), F.format_string("Balanced Accuracy: %.4f", "balanced_accuracy"), F.format_string("Macro-F1: %.4f", "macro_f1"), F.lit("Confusion Matrix:"),
                           F.concat(F.lit("[["), F.concat_ws(" ", n(0), n(1), n(2)), F.lit("]")), F.concat(F.lit(" ["), F.concat_ws(" ", n(3), n(4), n(5)), F.lit("]")), F.concat(F.lit(" ["), F.concat_ws(" ", n(6), n(7), n(8)), F.lit("]]"))]
    lines = F.array(F.concat(F.lit("========== Fold: "), "fold", F.lit(" ==========")), F.lit("Epoch 1 | loss 0.5"), *block("Final validation metrics:"), *block("Final test metrics:"), F.lit("TRAIN fingerprint stats: {'n': 3}"))
    doc = f.groupBy("variant").agg(F.sort_array(F.collect_list(F.struct("fold", F.array_join(lines, "\n").alias("s")))).alias("d"))
    text = F.concat(F.lit("device cuda\nSeed random = 42\n"), F.array_join(F.transform("d", lambda x: x["s"]), "\n"))
    folder = F.regexp_replace("variant", "[^A-Za-z0-9-]", "_")
    # one document per folder; a text line break inside a value keeps the document one file
    doc.select(folder.alias("run"), text.alias("value")).repartition("run").write.partitionBy("run").text(path)
    return logs.parse_logs(logs.read_lines(t.spark, path, "*.txt")).withColumn("run", F.regexp_extract("file", r"run=([^/]+)/", 1))


_RUNS = f"(SELECT regexp_replace(variant, '[^A-Za-z0-9-]', '_', 'g') AS run, fold, round(accuracy, 4) AS a, round(balanced_accuracy, 4) AS b, round(macro_f1, 4) AS f FROM {FOLDS})"


@query("src10_parse_logs", "run:s split_seed:i fold:i val_accuracy:d4 test_balanced_accuracy:d4 test_macro_f1:d4 test_conf_matrix:s train_fingerprint_stats:s", f"""
    SELECT r.run, 42 AS split_seed, r.fold, a AS val_accuracy, b AS test_balanced_accuracy, f AS test_macro_f1, m AS test_conf_matrix, '{{"n": 3}}' AS train_fingerprint_stats FROM {_RUNS} r
    JOIN (SELECT regexp_replace(variant, '[^A-Za-z0-9-]', '_', 'g') AS run, fold, '[' || string_agg(rw, ',' ORDER BY t) || ']' AS m FROM (
      SELECT variant, fold, t, '[' || string_agg(n, ',' ORDER BY p) || ']' AS rw FROM (SELECT variant, fold, a.l AS t, b.l AS p, (SELECT count(*) FROM v_preds q WHERE q.variant = v.variant AND q.fold = v.fold AND q.true_label = a.l AND q.pred_label = b.l) AS n
        FROM (SELECT DISTINCT variant, fold FROM v_preds) v, range(3) a(l), range(3) b(l)) GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.run = r.run AND c.fold = r.fold""")
def _(t):
    return _log_files(t)


@query("src11_log_rollup", "run:s n_folds:i accuracy_mean:d accuracy_std:d macro_f1_mean:d", f"SELECT run, count(*) AS n_folds, avg(a) AS accuracy_mean, stddev_samp(a) AS accuracy_std, avg(f) AS macro_f1_mean FROM {_RUNS} GROUP BY 1")
def _(t):
    return logs.rollup(logs.long_metrics(_log_files(t), ["run", "split_seed", "fold"]))[1]


@query("src12_flatten_json", "event_id:i k:i missing:s whole:s", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, NULL AS missing, replace(props, ' ', '') AS whole FROM events")
def _(t):
    d = t.table("events").select("event_id", F.concat(F.lit('{"spec": {"level": '), "props", F.lit("}}")).alias("json"))
    return results.flatten_summaries(d, {"k": "spec.level.k", "missing": "spec.level.none", "whole": "spec.level"}, ["event_id"])


@query("src12_run_summaries", "folder_name:s test_acc:d9 val_bal_acc:d9 model_family:s fuse_method:s", f"SELECT 'run=' || variant || '-' || fold AS folder_name, accuracy AS test_acc, balanced_accuracy AS val_bal_acc, 'gnn' AS model_family, NULL AS fuse_method FROM {FOLDS}")
def _(t):
    path = scratch(t, "summaries")
    doc = F.to_json(F.struct(F.struct(F.col("accuracy")).alias("test_metrics"), F.struct(F.col("balanced_accuracy")).alias("val_metrics"), F.struct(F.struct(F.lit("gnn").alias("family")).alias("model")).alias("spec")))
    fold_metrics(t).select(F.concat_ws("-", "variant", "fold").alias("run"), doc.alias("value")).repartition("run").write.partitionBy("run").text(path)
    d = results.read_summaries(t.spark, path, "*.txt").withColumn("folder_name", F.url_decode("folder_name"))
    return results.flatten_summaries(d)


@query("src13_upsert", "result_key:s value:d seq:i", """
    WITH m AS (SELECT o_orderpriority || '/' || (o_custkey % 50) AS result_key, o_totalprice AS value, o_orderkey AS seq FROM orders),
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_key ORDER BY seq DESC) AS r FROM m WHERE seq % 2 = 0) WHERE r = 1),
    new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY result_key ORDER BY seq DESC) AS r FROM m WHERE seq % 7 = 1) WHERE r = 1)
    SELECT result_key, value, seq FROM new UNION ALL SELECT result_key, value, seq FROM old WHERE result_key NOT IN (SELECT result_key FROM new)""")
def _(t):
    m = t.table("orders").select(F.concat_ws("/", "o_orderpriority", F.col("o_custkey") % 50).alias("result_key"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("seq"))
    return results.upsert(m.filter("seq % 2 = 0"), store.latest(m.filter("seq % 7 = 1"), ["result_key"], "seq"), sort=["result_key"])


@query("src13_scan_results", "parent_folder:s id_folder:s avg_acc:d std_f1:d", f"""
    SELECT 'split=' || split AS parent_folder, 'fold=' || fold AS id_folder, round(avg(accuracy), 6) AS avg_acc, round(stddev_samp(macro_f1), 6) AS std_f1 FROM {FOLDS} GROUP BY 1, 2""")
def _(t):
    path = scratch(t, "results")
    m = ("accuracy", "balanced_accuracy", "macro_f1")
    g = fold_metrics(t).groupBy("split", "fold").agg(*[F.round(f(x), 6).alias(f"{n}_{x}") for x in m for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), *[F.col(f"{n}_{x}").alias(x) for x in m]) for n in ("mean", "std")]))
    g.select("split", "fold", rows.alias("r")).select("split", "fold", "r.*").repartition("split", "fold").write.partitionBy("split", "fold").option("header", "true").csv(path)
    return results.scan_results(t.spark, path, "*.csv")


@query("src14_sinks", "fmt:s n:i total:d4", "SELECT f AS fmt, n, total FROM (SELECT count(*) AS n, sum(p0) AS total FROM v_preds), (VALUES ('csv'), ('json'), ('parquet')) v(f)")
def _(t):
    p, out = t.preds.select("instance_id", F.get("prob", 0).alias("p0"), "prob"), None
    for fmt in ("csv", "json", "parquet"):
        path = scratch(t, fmt)
        results.save_table(p, path, fmt)
        r = t.spark.read.schema("instance_id bigint, p0 double").option("header", "true").format(fmt).load(path)
        r = r.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.sum("p0").alias("total"))
        out = r if out is None else out.unionByName(r)
    return out


@query("src15_manifest_reader", "subject_id:s segment_id:i kmeans_cluster_id:i keep_clean:b split:s true_label:i", """
    SELECT split || '_' || subject_id AS subject_id, segment_id, cluster AS kmeans_cluster_id, keep_clean, split, -1 AS true_label FROM v_manifest""")
def _(t):
    path = scratch(t, "manifest")
    keep = F.when(F.col("keep_clean"), F.when(F.col("segment_id") % 2 == 0, "True").otherwise("yes")).otherwise("False")
    t.manifest.select(F.concat_ws("_", "split", "subject_id").alias("subject_id"), "segment_id", F.col("cluster").alias("kmeans_cluster_id"), keep.alias("keep_clean")).write.option("header", "true").csv(path)
    return manifests.read_manifest(t.spark, path)


@query("udf01_custom_family", "subject_id:i segment_id:i channel:s family:s feature:s value:d9", """
    SELECT subject_id, segment_id, channel, 'span' AS family, 'range' AS feature, max(value) - min(value) AS value FROM v_windows GROUP BY 1, 2, 3""")
def _(t):
    ft.register_family("span", lambda w, fs, b: (w, F.array(F.struct(F.lit("range").alias("feature"), (F.array_max("x") - F.array_min("x")).alias("value")))))
    return ft.feature_set(t.windows.drop("start_sample", "end_sample"), ["span"], FS)


@query("udf02_custom_hooks", "subject_id:i segment_id:i channel:s k:i value:d", """
    SELECT subject_id, segment_id, channel, k, 2 * (value - 1) AS value FROM v_windows WHERE subject_id % 3 <> 1""")
def _(t):
    w = prj.filter_subjects(t.windows, predicate=lambda d: F.col("subject_id") % 3 != 1)
    return rec.map_windows(w, lambda m: 2 * (m - 1)).select("subject_id", "segment_id", "channel", F.posexplode("x").alias("k", "value"))


@query("udf02_custom_reference", "subject_id:i channel:s t:i value:d", "SELECT subject_id, channel, t, value - max(value) OVER (PARTITION BY subject_id, t) AS value FROM v_samples")
def _(t):
    from pyspark.sql import Window

    return prj.reference(t.samples, "custom", custom=lambda d: F.col("value") - F.max("value").over(Window.partitionBy("subject_id", "t")))
