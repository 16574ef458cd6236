"""Recordings and their labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import fixed_map, pick_first
from ..functions.fixed import GROUP_CODES, SYMPTOM_RULES
from ..operators.ordered import attach

RECORD_SCHEMA = ("subject_id string, dataset_name string, label string, label_id int, sfreq double, channels array<string>, metadata map<string,string>, "
                 "source_path string, session_id string, montage_type string, signal_unit string, n_samples bigint")


def read_recordings(spark: SparkSession, path: str, *, subjects: DataFrame | None = None, max_subjects: int | None = None, glob: str | None = None) -> DataFrame:
    """SRC01: one row per recording from Parquet; an optional list of ids and number of subjects (by id); the samples are a
    table of their own, so nothing is loaded that is not asked for."""
    r = spark.read.schema(RECORD_SCHEMA).option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return choose_recordings(r.parquet(path), subjects, max_subjects)


def choose_recordings(df: DataFrame, subjects: DataFrame | None = None, max_subjects: int | None = None) -> DataFrame:
    if subjects is not None:
        df = df.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return df.orderBy("subject_id").limit(max_subjects) if max_subjects is not None else df


def list_files(spark: SparkSession, root: str, pattern: str = "*.set") -> DataFrame:
    """SRC01: files under a folder by glob: path, size, and the subject folder in the path; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    return f.withColumn("subject_id", F.regexp_extract("path", r"(sub-[^/]+)", 1))


def read_participants(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    return spark.read.option("header", "true").option("sep", sep).csv(path)


def group_labels(participants: DataFrame, task: str = "all3", *, group: str = "Group", deny: Sequence[str] = ()) -> DataFrame:
    """SRC02: group code to class id for the task; codes outside the task and listed participants are dropped."""
    if task not in GROUP_CODES:
        raise ValueError(f"unknown task {task!r}")
    p = participants.withColumn("label", F.try_element_at(fixed_map(GROUP_CODES[task]), F.col(group))).filter("label IS NOT NULL")
    return p.filter(~F.col("participant_id").isin(list(deny))) if deny else p


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """SRC03: rows of the ``data`` array of a JSON index: serial and symptoms."""
    j = spark.read.schema("data array<struct<serial:string,symptom:array<string>>>").option("multiLine", "true").json(path)
    return j.select(F.explode("data").alias("d")).select("d.serial", "d.symptom")


def symptom_labels(annotations: DataFrame, width: int = 5) -> DataFrame:
    """SRC03: the first rule whose words meet the symptoms decides; serials are zero-padded; other rows are dropped."""
    s = F.transform(F.coalesce("symptom", F.array().cast("array<string>")), F.lower)
    label, name = None, None
    for k, (n, words) in enumerate(SYMPTOM_RULES):
        hit = F.arrays_overlap(s, F.array(*[F.lit(w) for w in words]))
        label = F.when(hit, k) if label is None else label.when(hit, k)
        name = F.when(hit, n) if name is None else name.when(hit, n)
    padded = F.when(F.length("serial") < width, F.lpad("serial", width, "0")).otherwise(F.col("serial"))
    return annotations.withColumn("serial", padded).withColumn("label", label).withColumn("class_name", name).filter("label IS NOT NULL")


def resolve_official(serials: DataFrame, stored: DataFrame, bad: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC04: official (split, serial) to stored subject ids, first as they are, then with the split prefix; returns matches and
    the serials that have none."""
    s = serials.join(bad.select("serial"), "serial", "left_anti") if bad is not None else serials
    cand = s.select("split", "serial", F.posexplode(F.array(F.col("serial"), F.concat_ws("_", "split", "serial"))).alias("_r", "subject_id"))
    hit = pick_first(cand.join(stored.select("subject_id").distinct(), "subject_id", "left_semi"), ["split", "serial"], F.col("_r")).drop("_r")
    return hit, s.join(hit.select("split", "serial"), ["split", "serial"], "left_anti")


def require_all(matches: DataFrame, missing: DataFrame) -> DataFrame:
    """SRC04: the matches, or an error naming how many serials are missing (raised when the result is computed)."""
    n = missing.agg(F.count("*").alias("_missing"))
    ok = F.when(F.col("_missing") > 0, F.raise_error(F.concat(F.col("_missing").cast("string"), F.lit(" official serials are not stored")))).otherwise(F.lit(True))
    return attach(matches, n, []).filter(ok).drop("_missing")
