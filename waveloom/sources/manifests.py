"""Window manifests as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str, **kw) -> DataFrame:
    return normalize_manifest(spark.read.option("header", "true").csv(path), **kw)


def normalize_manifest(raw: DataFrame, *, required: Sequence[str] = ("subject_id", "segment_id"), cluster: str = "kmeans_cluster_id", label: str = "true_label") -> DataFrame:
    """SRC15: check required columns, cast ids, read boolean text, derive the split from the id prefix, and fill defaults
    (kept, label -1)."""
    missing = [r for r in required if r not in raw.columns]
    if missing:
        raise KeyError(f"manifest misses columns {missing}")
    m = raw.withColumn("subject_id", F.col("subject_id").cast("string")).withColumn("segment_id", F.col("segment_id").cast("long"))
    if cluster in m.columns:
        m = m.withColumn(cluster, F.col(cluster).cast("int"))
    keep = F.lower(F.trim(F.col("keep_clean").cast("string"))).isin("true", "1", "yes") if "keep_clean" in m.columns else F.lit(True)
    m = m.withColumn("keep_clean", F.coalesce(keep, F.lit(True)))
    prefix = F.coalesce(F.nullif(F.regexp_extract("subject_id", r"^(train|val|test)_", 1), F.lit("")), F.lit("unknown"))
    m = m.withColumn("split", F.coalesce(F.col("split"), prefix) if "split" in m.columns else prefix)
    return m.withColumn(label, F.coalesce(F.col(label).cast("int"), F.lit(-1)) if label in m.columns else F.lit(-1))
