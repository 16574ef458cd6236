"""Run summaries, the table of results, and output files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import pick_first

# flat columns of a run's summary, as {path of the object: {column: key}} (fixed values)
_METRIC_KEYS = {"num_samples": "num_samples", "acc": "accuracy", "bal_acc": "balanced_accuracy", "macro_f1": "macro_f1", "confusion_matrix": "confusion_matrix"}
_SCORE_KEYS = {"brier": "brier_score", "roc_auc_macro_ovr": "roc_auc_macro_ovr", "pr_auc_macro_ovr": "pr_auc_macro_ovr"}


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


SUMMARY_OBJECTS = {
    "": _same("best_epoch", "monitor", "monitor_value", "class_names"),
    "test_metrics": {f"test_{k}": v for k, v in {**_METRIC_KEYS, **_SCORE_KEYS}.items()},
    "val_metrics": {f"val_{k}": v for k, v in {**_METRIC_KEYS, **_SCORE_KEYS}.items()},
    "train_metrics": {f"train_{k}": v for k, v in _METRIC_KEYS.items()},
    "spec": {"spec_name": "name", **_same("h5_path", "feature_families")},
    "spec.train": _same("batch_size", "lr", "weight_decay", "epochs", "patience", "seed"),
    "spec.level": _same("graph_level", "macro_duration_sec", "feature_reduce", "connectivity_reduce"),
    "spec.topology": {"topology_strategy": "strategy", "topology_similarity": "similarity", **_same(
        "topology_metric", "topology_band", "topology_kwargs", "graph_bank_specs", "fuse_method", "fuse_topology_rule", "fuse_vote_threshold", "primary_candidate")},
    "spec.edge_weights": {"edge_weight_strategy": "strategy", "fused_method_edge": "fused_method", **_same("edge_metric", "edge_band", "normalize_mode", "fused_sources")},
    "spec.connectivity_tensor": {"connectivity_tensor_metrics": "metrics", "connectivity_tensor_bands": "bands"},
    "spec.model": {"model_family": "family", **_same(
        "connectivity_encoder_type", "backbone", "hidden_dim", "emb_dim", "dropout", "num_layers", "gat_heads", "use_edge_weight", "use_batchnorm", "graph_readout", "fusion_mode", "graph_bank_fusion_mode")},
    "spec.aggregation": {"aggregation_strategy": "strategy", **_same("posthoc_eval_vote", "attn_dim", "train_max_instances_per_subject")},
}
SUMMARY_PATHS = {col: f"{obj}.{key}".lstrip(".") for obj, cols in SUMMARY_OBJECTS.items() for col, key in cols.items()}


def read_summaries(spark: SparkSession, root: str, name: str = "summary.json") -> DataFrame:
    """SRC12: whole JSON text of every summary under a folder, with its run folder."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return t.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder_name"), F.col("value").alias("json"))


def flatten_summaries(docs: DataFrame, paths: dict[str, str] = SUMMARY_PATHS, keys: Sequence[str] = ("folder_name",), text: str = "json") -> DataFrame:
    """SRC12: nested paths to flat text columns; a missing path is null, lists and objects stay JSON text."""
    return docs.select(*keys, *[F.get_json_object(text, f"$.{p}").alias(n) for n, p in paths.items()])


def result_key(path, base: str):
    """SRC13: folder of a result file relative to the base folder."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]+$", 1), f"^(file:)?/*{base.strip('/')}/*", "")


def scan_results(spark: SparkSession, base: str, name: str = "overall_summary_test.csv") -> DataFrame:
    """SRC13: mean and std rows of every result CSV under a folder as one row per result key."""
    r = spark.read.schema("stat string, accuracy double, balanced_accuracy double, macro_f1 double").option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).csv(base)
    r = r.select("*", F.col("_metadata.file_path").alias("csv_path"), F.col("_metadata.file_modification_time").alias("csv_mtime"))
    pick = lambda s, m: F.max(F.when(F.col("stat") == s, F.col(m)))
    g = r.groupBy("csv_path", "csv_mtime").agg(pick("mean", "accuracy").alias("avg_acc"), pick("mean", "balanced_accuracy").alias("avg_bal_acc"), pick("mean", "macro_f1").alias("avg_f1"),
                                               pick("std", "accuracy").alias("std_acc"), pick("std", "balanced_accuracy").alias("std_bal_acc"), pick("std", "macro_f1").alias("std_f1"))
    k = result_key(F.col("csv_path"), base)
    return g.withColumn("result_key", k).withColumn("parent_folder", F.get(F.split("result_key", "/"), 0)).withColumn("id_folder", F.element_at(F.split("result_key", "/"), -1))


def upsert(master: DataFrame, new: DataFrame, key: str = "result_key", *, order: str = "seq", sort: Sequence[str] = ()) -> DataFrame:
    """SRC13: the master (last row per key) with rows of keys in ``new`` replaced."""
    old = pick_first(master, [key], F.desc(order))
    out = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)
    return out.orderBy(*[F.col(s).asc_nulls_last() for s in sort]) if sort else out


def save_table(df: DataFrame, path: str, fmt: str = "parquet", *, one_file: bool = False, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """SRC14: CSV, JSON or Parquet. Nested values become JSON text in CSV. ``one_file`` is for small summaries."""
    out = df
    if fmt == "csv":
        for n, t in df.dtypes:
            if t.startswith(("array", "map", "struct")):
                out = out.withColumn(n, F.to_json(n))
    if one_file:
        out = out.coalesce(1)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    {"csv": lambda: w.option("header", "true").csv(path), "json": lambda: w.json(path), "parquet": lambda: w.parquet(path)}[fmt]()
