"""Token counts of flat, unindexed token files by scanning for the end-of-document id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import Scratch, table, utf8


def write_flat(docs: DataFrame, path: str, vocabulary: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = 1 << 20) -> None:
    """Encode texts to flat token files below ``path``/tokens and note the texts' order in ``path``/order.

    A file is the ids of its texts, one after another, each closed by ``end_id``, as little-endian
    integers of ``width`` bytes, cut into blocks of ``block_bytes`` bytes with no regard to texts: row (file, block,
    data, width). Nothing in it says where a text begins. Strings of special tokens in a text are encoded as
    ordinary text, so the end id occurs at the ends only. ``order`` has (file, place, id): the place
    of each text in its file. One task writes one file, whole or not at all.
    """
    box = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def encode(batches):
        from pyspark import TaskContext

        coder, file = wordbpe.load(box.value), TaskContext.get().partitionId()
        buffer, block, place, width = bytearray(), 0, 0, None

        def row(data):
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary()), "width": pa.array([width], pa.int32()),
                                               "place": pa.array([None], pa.int64()), "id": pa.array([None], pa.int64())})

        for batch in batches:
            names = batch.schema.names
            texts = utf8(batch.column(names.index(text_col)))
            for lo in range(0, len(texts), 512):
                ids = coder.encode_arrow(texts.slice(lo, 512), end_id, literal=True)[0]
                width = ids.dtype.itemsize
                buffer += ids.tobytes()
                while len(buffer) >= block_bytes:
                    yield row(bytes(buffer[:block_bytes]))
                    del buffer[:block_bytes]
                    block += 1
            n = len(texts)
            yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.int32()), "block": pa.nulls(n, pa.int64()), "data": pa.nulls(n, pa.binary()), "width": pa.nulls(n, pa.int32()),
                                              "place": pa.array(range(place, place + n), pa.int64()), "id": batch.column(names.index(id_col)).cast(pa.int64())})
            place += n
        if buffer:
            yield row(bytes(buffer))

    both = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(encode, "file int, block long, data binary, width int, place long, id long")
    # one pass writes both: rows with data are token blocks, the others are the order of the texts
    both.withColumn("kind", F.when(F.col("data").isNull(), "order").otherwise("tokens")).write.option("compression", "zstd").partitionBy("kind").parquet(path)


def count_tokens(blocks: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """file, place, start, n_tokens of every text in flat token files (file, block, data, and ``width``: bytes of an id; 2 where there is no such column).

    Each block is searched on its own, by one vectorised comparison; it yields its number of ids, its
    number of end ids and their positions. A prefix sum over the blocks of a file gives each block
    the ids and texts before it, and the last end before it; so a text that runs over many blocks is
    stitched from its first and last block without moving ids. ``n_tokens`` counts the ids up to and
    with the end id; ids after a file's last end id form a last text of their own (it has no end).
    Empty files and blocks give no rows. A block must hold a whole number of ids.
    """

    def scan(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[k].as_py(), f"<u{batch.column(3)[k].as_py()}")
                at = np.flatnonzero(ids == end_id)
                yield pa.RecordBatch.from_pydict({"file": batch.column(0).slice(k, 1), "block": batch.column(1).slice(k, 1), "n_ids": [len(ids)], "n_ends": [len(at)],
                                                  "last": pa.array([int(at[-1]) if len(at) else None], pa.int64()), "ends": pa.array([at.astype(np.int32)], pa.list_(pa.int32()))})

    wide = F.coalesce("width", F.lit(width)) if "width" in blocks.columns else F.lit(width)
    found = blocks.select("file", "block", "data", wide.alias("width")).mapInArrow(scan, "file int, block long, n_ids long, n_ends long, last long, ends array<int>")
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    stitched = (found.withColumn("begin", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))
                .withColumn("texts", F.coalesce(F.sum("n_ends").over(w), F.lit(0)))
                .withColumn("open", F.coalesce(F.max(F.col("last") + F.sum("n_ids").over(up_to) - F.col("n_ids") + 1).over(w), F.lit(0))))
    return _texts(stitched)


def _texts(stitched: DataFrame) -> DataFrame:
    """One row per end id: it closes what its predecessor in the block, or the open text before the block, began."""
    e = F.col("ends")
    pairs = F.transform(e, lambda x, i: F.struct(
        i.cast("long").alias("k"), (F.col("begin") + x + 1).alias("stop"),
        F.when(i == 0, F.col("open")).otherwise(F.col("begin") + F.get(e, i - 1) + 1).alias("start")))
    closed = stitched.select("file", (F.col("texts")).alias("_t"), F.explode(pairs).alias("p")).select(
        "file", (F.col("_t") + F.col("p.k")).alias("place"), F.col("p.start").alias("start"), (F.col("p.stop") - F.col("p.start")).alias("n_tokens"))
    ends = stitched.groupBy("file").agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("place"), F.max(F.col("begin") + F.col("last") + 1).alias("stop"))
    open_ = ends.select("file", "place", F.coalesce("stop", F.lit(0)).alias("start"), (F.col("n") - F.coalesce("stop", F.lit(0))).alias("n_tokens")).filter("n_tokens > 0")
    return closed.unionByName(open_)


def document_counts(docs: DataFrame, vocabulary: bytes, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as flat token files, scan those, and return (id, file, place, start, n_tokens) per text.

    Null and empty texts hold the end id alone; a null id is returned as null; repeated rows count
    one by one; other columns are not read.
    """
    spark = docs.sparkSession
    path = f"{Scratch(spark).root}/flat"
    write_flat(docs, path, vocabulary, end_id, id_col, text_col)
    both = spark.read.schema("file int, block long, data binary, width int, place long, id long, kind string").parquet(path)
    counts = count_tokens(both.filter("kind = 'tokens'").select("file", "block", "data", "width"), end_id)
    order = both.filter("kind = 'order'").select("file", "place", F.col("id").alias(id_col))
    return order.join(counts, ["file", "place"]).select(id_col, "file", "place", "start", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocabulary = f.read()
    return document_counts(table(spark, sf_dir, "documents"), vocabulary, end_id=49407).select("doc_id", "start", "n_tokens", "file", "place")
