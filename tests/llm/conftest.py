"""A small corpus with every odd case, and the pieces that the tests share."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id string, block string, n string, id string, job string"
WORDS = ["the", "of", "and", "Alpha", "beta,", "gamma", "delta.", "naïve", "über", "12", "kg", "x|y", "***"]


def texts():
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base = [make(rng.randrange(1, 120)) for _ in range(40)]
    shared = make(60)
    out = list(enumerate(base))
    out += [(100 + k, f"{make(30)} {shared}\n{make(30)}") for k in range(6)]  # a passage in many documents
    out += [(200 + k, base[3]) for k in range(4)]  # exact copies
    near = make(200).split()
    for k in range(5):  # near copies: a word or two changed
        w = list(near)
        w[20 + 30 * k] = f"changed{k}"
        out.append((300 + k, " ".join(w)))
    out += [(400, None), (401, ""), (402, " \n\t "), (403, "one"), (404, "one two"), (405, "one two"), (406, make(30_000)), (407, "a" * 5000 + " " + "é" * 300)]
    out += [(500, make(50))] * 2 + [(None, make(20)), (None, None), (None, shared)]
    return out


@pytest.fixture(scope="session")
def corpus():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en" if k % 3 else None, None if k % 5 else "s", None, 0.5, "x", "b", "n", "i", "j") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table_dir(spark, docs, tmp_path_factory):
    """The corpus with labels and a benchmark as a folder of tables."""
    d = str(tmp_path_factory.mktemp("tables"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{d}/documents.parquet")
    plain.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 7 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic")).distinct().write.parquet(f"{d}/labels.parquet")
    item = plain.filter("doc_id = 5").select(F.lit(1).cast("long").alias("item_id"), "text")
    item.unionByName(spark.createDataFrame([(2, None), (3, "short")], "item_id long, text string")).write.parquet(f"{d}/benchmark.parquet")
    return d
