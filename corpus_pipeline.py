"""From documents to tokens: quality, near duplicates, repeated passages, benchmark leaks, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.
Rows without an id are never dropped as copies; empty texts have no set, no window and no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waveloom.llm import jaccard, pieces, quality, substring, templates
from waveloom.llm.common import Scratch, table


def _free(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score is 0.7 or more; learned from all labelled documents."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(_free(docs, n) for n in ("score", "predicted"))
    return quality.score(docs, model, names=names).filter(F.col(names[1]) == 1).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; of rows that repeat an id, one."""
    found, _ = Scratch(spark).land(jaccard.near_duplicates(docs).filter("doc_id is not null"))
    # both joins sort by id at any size, so the plan that is tested is the plan that runs at scale
    kept = docs.join(found.filter("class_id <> doc_id").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti")
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice.hint("merge"), "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 13 words and more that a document with a smaller id has; other documents keep their text as it is."""
    taken = [c for c in docs.columns if c in ("_chunk", "_n_words", "_n_removed")]
    aside = {c: _free(docs, f"_own{c}") for c in taken}
    out = substring.remove_repeats(docs.withColumnsRenamed(aside), tidy=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, also with other numbers or names; those without an id too.

    A row's key is its id and a hash of its text, so rows that share an id, or have none, are judged each by its own text.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    leaks = templates.find_leaks(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks.select(F.col("doc_id").alias("_leak")), key == F.col("_leak"), "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    return pieces.digests(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", distinct_documents),
    ("substring dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("SentencePiece encoding", tokens),
]

#: SQL can express neither the classifier nor the piece encoding; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        out, written = scratch.land(stage(spark, docs, sf_dir))
        if path:
            scratch.drop(path)
        docs, path = out, written
    return docs
