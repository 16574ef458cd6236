"""Cutting lineage through a table in the shared folder of the session."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def _qualified(spark: SparkSession, folder: str):
    """The folder as a Hadoop path with its scheme, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(path), fs


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, a folder below the warehouse.

    A cluster must name a folder that all executors share: without the setting, a warehouse on a
    machine's own disk is accepted only if driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    path, fs = _qualified(spark, spark.conf.get("spark.sql.warehouse.dir"))
    if fs.getScheme() == "file" and not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{path.toString().rstrip('/')}/_scratch"


def app_dir(spark: SparkSession) -> str:
    """This application's folder in the shared folder; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/waveloom/{app}"
    if _ROOTS.get(app) != root:
        path, fs = _qualified(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS[app] = root
    return root


def grouped(writer, group_bytes: int | None):
    """``group_bytes``: size of a row group where a row may be megabytes. A task that writes or reads holds one group at a time; without
    it the size is looked at every 100 rows only, so all rows of a task may be one group."""
    if not group_bytes:
        return writer
    return writer.options(**{"parquet.block.size": str(group_bytes), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"})


def land(df: DataFrame, partition_by: list[str] | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; ``group_bytes`` as in ``grouped``.

    Later stages read a fixed table, so a lost executor never recomputes (or re-numbers) it, and
    column pruning and filters reach the files.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{uuid.uuid4().hex}"
    writer = grouped(df.write.mode("errorifexists"), group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
