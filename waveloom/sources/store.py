"""Store of windows, features and connectivity as partitioned Parquet tables behind a manifest.

A write puts its rows into new folders and then names them in a new manifest, by one rename. Readers go through the newest
manifest, so they see all tables of a write or none, and a job that dies at any step leaves folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import pick_first

TABLES = {"windows": [], "features": ["family"], "connectivity": ["metric"]}


def _files(spark: SparkSession, path: str):
    """The store's file system, and a function from names below the store to Hadoop paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, lambda *names: make("/".join([path.rstrip("/"), *names]))


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, list[str]]]:
    """Number of the newest manifest (0 where there is none) and the live folders of each table, oldest first."""
    fs, at = _files(spark, path)
    if not fs.exists(at("_manifest")):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(at("_manifest"))]
    newest = max((n for n in names if n.endswith(".json") and not n.startswith(("_", "."))), default=None)
    if newest is None:
        return 0, {}
    stream = fs.open(at("_manifest", newest))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return int(newest.split(".")[0]), json.loads(text)


def _commit(spark: SparkSession, path: str, version: int, live: dict[str, list[str]]) -> None:
    """Name the live folders in manifest ``version``: written aside, then renamed. A manifest of that number from another job raises."""
    fs, at = _files(spark, path)
    fs.mkdirs(at("_manifest"))
    aside, final = at("_manifest", f"_{uuid.uuid4().hex}"), at("_manifest", f"{version:012d}.json")
    stream = fs.create(aside, True)
    stream.write(bytearray(json.dumps(live).encode()))
    stream.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise RuntimeError(f"another job has written to the store {path} meanwhile")


def _sweep(spark: SparkSession, path: str, live: dict[str, list[str]]) -> None:
    """Delete folders that the newest manifest does not name: left by jobs that died, or replaced by an overwrite."""
    fs, at = _files(spark, path)
    for name in TABLES:
        if fs.exists(at(name)):
            for f in fs.listStatus(at(name)):
                if f"{name}/{f.getPath().getName()}" not in live.get(name, []):
                    fs.delete(f.getPath(), True)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """All rows of a table that are committed; None where it has none."""
    folders, root = manifest(spark, path)[1].get(name), path.rstrip("/")
    return spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{f}" for f in folders]).drop("commit") if folders else None


def write_store(path: str, tables: dict[str, DataFrame], *, overwrite: bool = False, subject: str = "subject_id", segment: str = "segment_id") -> None:
    """SRC05: append window, feature and connectivity rows; subjects that are stored already are skipped, unless all is overwritten.

    A subject counts as stored if the table that leads the write (the windows where given, else each table itself) has committed rows of
    it. All tables of a call become visible together. An overwrite replaces the tables of the call and keeps the others. One job writes at a time:
    a second one that ends later raises and leaves nothing; folders without a manifest are removed by the next write.

    Feature tables are partitioned by family and connectivity by metric, so a read of few of them touches few files. Rows are range
    partitioned and sorted by (partition, subject, segment): a subject with many rows is spread over files, and
    subject filters skip files and row groups.
    """
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    version, live = manifest(spark, path)
    _sweep(spark, path, live)
    after = {k: list(v) for k, v in live.items()}
    lead = None if overwrite or "windows" not in tables else stored_subjects(spark, path, "windows", subject)
    for name, df in tables.items():
        own = lead if "windows" in tables else None if overwrite else stored_subjects(spark, path, name, subject)
        if own is not None:
            df = df.join(own, subject, "left_anti")
        parts = TABLES[name]
        order = [*parts, subject, *([segment] if segment in df.columns else [])]
        w = df.repartitionByRange(*[F.col(c) for c in order], F.xxhash64(*[c for c in df.columns if c not in parts])).sortWithinPartitions(*order)
        folder = f"{name}/commit=w{uuid.uuid4().hex}"
        (w.write.partitionBy(*parts) if parts else w.write).parquet(f"{path}/{folder}")
        fs, at = _files(spark, path)
        some = any(not f.getPath().getName().startswith("_") for f in fs.listStatus(at(folder)))
        after[name] = [*([] if overwrite else after.get(name, [])), *([folder] if some else [])]
    _commit(spark, path, version + 1, after)
    _sweep(spark, path, after)


def stored_subjects(spark: SparkSession, path: str, name: str = "windows", subject: str = "subject_id") -> DataFrame | None:
    df = read_table(spark, path, name)
    return None if df is None else df.select(subject).distinct()


def _committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    df = read_table(spark, path, name)
    if df is None:
        raise FileNotFoundError(f"the store {path} has no {name}")
    return df


def read_features(spark: SparkSession, path: str, families: Sequence[str], *, subjects: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """SRC06: chosen families (partition pruning) of chosen subjects, with an optional bad-window flag joined."""
    return choose_features(_committed(spark, path, "features"), families, subjects=subjects, bad=bad)


def choose_features(features: DataFrame, families: Sequence[str], *, subjects: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    f = features.filter(F.col("family").isin(list(families)))
    if subjects is not None:
        f = f.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    if bad is not None:
        f = f.join(bad.select("subject_id", "segment_id", F.lit(True).alias("_b")), ["subject_id", "segment_id"], "left").withColumn("bad_segment_flag", F.coalesce("_b", F.lit(False))).drop("_b")
    return f


def read_connectivity(spark: SparkSession, path: str, metric: str, *, bands: Sequence | None = None, band_names: Sequence[str] | None = None) -> DataFrame:
    """SRC07: one metric (partition pruning), all or the listed bands in their order."""
    return choose_bands(_committed(spark, path, "connectivity"), metric, bands, band_names)


def choose_bands(edges: DataFrame, metric: str, bands: Sequence | None = None, band_names: Sequence[str] | None = None) -> DataFrame:
    """SRC07: bands by name or index; ``band_index`` keeps the requested order; an unknown band raises at once when names are known."""
    e = edges.filter(F.col("metric") == metric)
    if bands is None:
        return e
    names = []
    for b in bands:
        if isinstance(b, int):
            if band_names is None or not 0 <= b < len(band_names):
                raise KeyError(f"unknown band index {b}")
            names.append(band_names[b])
        else:
            if band_names is not None and b not in band_names:
                raise KeyError(f"unknown band {b!r}")
            names.append(b)
    order = F.array(*[F.lit(n) for n in names])
    return e.filter(F.col("band").isin(names)).withColumn("band_index", (F.array_position(order, F.col("band")) - 1).cast("int"))


def inventory(features: DataFrame | None = None, connectivity: DataFrame | None = None) -> DataFrame:
    """SRC08: kind, name, subjects, rows and members (feature or band names) of a store."""
    out = None
    for df, kind, key, member in ((features, "features", "family", "feature"), (connectivity, "connectivity", "metric", "band")):
        if df is None:
            continue
        d = df.groupBy(key).agg(F.count_distinct("subject_id").alias("n_subjects"), F.count("*").alias("n_rows"), F.array_join(F.sort_array(F.collect_set(member)), ",").alias("members"))
        d = d.select(F.lit(kind).alias("kind"), F.col(key).alias("name"), "n_subjects", "n_rows", "members")
        out = d if out is None else out.unionByName(d)
    return out


def merge_stores(train_store: DataFrame, other_store: DataFrame, *, existing: DataFrame | None = None, val: Sequence[str] = ("val_", "validation_"), test: Sequence[str] = ("test_",),
                 subject: str = "subject_id") -> DataFrame:
    """SRC09: train subjects from the first store, val and test subjects from the second; subjects of ``existing`` are skipped."""
    def starts(prefixes):
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | F.col(subject).startswith(p)
        return cond

    a = train_store.filter(F.col(subject).startswith("train_")).withColumn("source", F.lit("train_store"))
    b = other_store.filter(starts([*val, *test])).withColumn("source", F.lit("other_store"))
    both = a.unionByName(b)
    return both if existing is None else both.join(existing.select(subject).distinct(), subject, "left_anti").select(both.columns)


def merge_report(merged: DataFrame, existing: DataFrame | None = None, subject: str = "subject_id") -> DataFrame:
    """SRC09: per source and split: subjects requested, copied and skipped because they exist."""
    s = merged.select("source", subject).distinct().withColumn("split", F.coalesce(F.nullif(F.regexp_extract(subject, r"^(train|validation|val|test)_", 1), F.lit("")), F.lit("unknown")))
    s = s.join(existing.select(subject).distinct().withColumn("_old", F.lit(1)), subject, "left") if existing is not None else s.withColumn("_old", F.lit(None).cast("int"))
    return s.groupBy("source", "split").agg(F.count("*").alias("requested"), F.count(F.when(F.col("_old").isNull(), 1)).alias("copied"), F.count("_old").alias("skipped_existing"))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    return pick_first(rows, list(keys), F.desc(order))
