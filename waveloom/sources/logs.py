"""Training logs as metric rows, and their roll-up per run folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.landing import land
from ..operators.ordered import positions, running

# line patterns of a run log (fixed values)
SEED = r"Seed random\s*=\s*(\d+)"
FOLD = r"=+\s*Fold:\s*(\d+)\s*=+"
METRICS = {
    "accuracy": r"^Accuracy:\s*([0-9.]+)\s*$",
    "balanced_accuracy": r"^Balanced Accuracy:\s*([0-9.]+)\s*$",
    "macro_f1": r"^Macro-F1:\s*([0-9.]+)\s*$",
}


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC10: (file, line_no, line), files of any size read by lines.

    A line's number is its place by the offset of the file part it was read from and its order there.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, lineSep="\n")
    t = t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_part"), F.col("value").alias("line"))
    placed = positions(land(t.withColumn("_row", F.monotonically_increasing_id())), ["file"], ["_part", "_row"], "line_no")
    return placed.select("file", F.col("line_no").cast("int").alias("line_no"), "line")


def carry_forward(lines: DataFrame, group: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """SRC10: each column's last non-null value up to the row.

    The latest value is the running maximum of (place, value), so a group of any length stays spread.
    """
    pairs = {f"_f_{c}": ("max", F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v")))) for c in cols}
    r = running(lines, list(group), list(order), pairs)
    return r.select(*[c for c in lines.columns if c not in cols], *[F.col(f"_f_{c}._v").alias(c) for c in cols])


def parse_logs(lines: DataFrame) -> DataFrame:
    """SRC10: one row per (file, seed, fold) with validation and test metrics, confusion matrices and fingerprint texts."""
    s = F.trim("line")
    grab = lambda p: F.when(s.rlike(p), F.regexp_extract(s, p, 1))
    fold = grab(FOLD).cast("int")
    section = (F.when(s.startswith("Final validation metrics:"), "val").when(s.startswith("Final test metrics:"), "test")
               .when(s.rlike(r"^(TRAIN|TEST)\s+fingerprint stats:") | s.startswith("=========="), "none"))
    matrix = F.when(s.startswith("Confusion Matrix:"), "open").when(s.endswith("]]"), "last").when(section.isNotNull() | (s == ""), "closed")
    rows = lines.withColumn("split_seed", grab(SEED).cast("int")).withColumn("fold", fold).withColumn("section", section).withColumn("_mx", matrix)
    rows = carry_forward(rows.withColumn("_new", F.when(fold.isNotNull(), F.col("line_no"))), ["file"], ["line_no"], ["split_seed", "fold", "section", "_mx", "_new"])
    # the seed of a fold is the one in force where the fold starts
    rows = rows.filter("fold IS NOT NULL").withColumn("_s", F.trim("line"))
    in_matrix = F.col("_s").rlike(r"^\[") & F.col("_mx").isin("open", "last")
    vals = {m: F.when(F.col("_s").rlike(p), F.regexp_extract("_s", p, 1).cast("double")) for m, p in METRICS.items()}
    key = ["file", "fold", "_new"]
    aggs = [F.max_by("split_seed", -F.col("line_no")).alias("split_seed")]
    for sec in ("val", "test"):
        here = F.col("section") == sec
        for m, v in vals.items():
            aggs.append(F.max_by(F.when(here, v), F.when(here & v.isNotNull(), -F.col("line_no"))).alias(f"{sec}_{m}"))
        cells = F.array_sort(F.collect_list(F.when(here & in_matrix, F.struct("line_no", F.col("_s").alias("s")))))
        aggs.append(F.concat_ws(",", F.transform(cells, lambda c: F.regexp_replace(F.regexp_replace(c["s"], r"\s+", ","), r"\[,", "["))).alias(f"{sec}_conf_matrix"))
    for name, p in (("train_fingerprint_stats", r"^TRAIN\s+fingerprint stats:\s*(.*)$"), ("test_fingerprint_stats", r"^TEST\s+fingerprint stats:\s*(.*)$")):
        aggs.append(F.max(F.when(F.col("_s").rlike(p), F.translate(F.regexp_extract("_s", p, 1), "'", '"'))).alias(name))
    return rows.groupBy(*key).agg(*aggs).drop("_new")


def long_metrics(folds: DataFrame, keys: Sequence[str] = ("file", "split_seed", "fold")) -> DataFrame:
    """SRC11: one row per (fold, split) from the val_ and test_ columns."""
    cells = F.array(*[F.struct(F.lit(s).alias("split"), *[F.col(f"{s}_{m}").alias(m) for m in ("accuracy", "balanced_accuracy", "macro_f1")]) for s in ("val", "test")])
    return folds.select(*keys, F.explode(cells).alias("e")).select(*keys, "e.*")


def rollup(long: DataFrame, *, run: str = "run", seed: str = "split_seed", split: str = "test") -> tuple[DataFrame, DataFrame]:
    """SRC11: mean per split seed, and mean and sample std over fold rows per run folder."""
    m = ("accuracy", "balanced_accuracy", "macro_f1")
    t = long.filter(F.col("split") == split)
    by_seed = t.groupBy(run, seed).agg(*[F.avg(x).alias(x) for x in m])
    return by_seed, t.groupBy(run).agg(F.count("*").alias("n_folds"), *[f for x in m for f in (F.avg(x).alias(f"{x}_mean"), F.stddev_samp(x).alias(f"{x}_std"))])


def run_folder(file):
    """Column with the name of the folder that holds a log file."""
    return F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
