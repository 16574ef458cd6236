"""Shared helpers: scratch tables, Arrow text access, vectorised word and window hashes, connected components."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.landing import app_dir, grouped

U64 = np.uint64


# ---------------------------------------------------------------- scratch tables

class Scratch:
    """Tables of one operator run in the shared folder; each can be dropped as soon as nothing reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{app_dir(spark)}/{uuid.uuid4().hex}"
        self._n = 0

    def land(self, df: DataFrame, group_bytes: int | None = None) -> tuple[DataFrame, str]:
        self._n += 1
        path = f"{self.root}/{self._n}"
        grouped(df.write.option("compression", "zstd"), group_bytes).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- Arrow text

def utf8(column) -> pa.StringArray | pa.LargeStringArray:
    """A string column as one contiguous array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.fill_null("") if column.null_count else column


def utf8_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets into them. No copy is made of the texts."""
    _, off, data = arr.buffers()
    wide = pa.types.is_large_string(arr.type)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or len(o) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[o[0]: o[-1]], o - o[0]


def text_from_bytes(blob: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.LargeStringArray:
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(blob), mask)


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs of rows of at most ``limit`` bytes, or one row where that row alone is longer."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


# ---------------------------------------------------------------- words

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (finaliser of a multiply-shift hash); overflow wraps."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, U64(b))])) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


class Words:
    """Words (runs of bytes other than ASCII white space) of consecutive texts.

    ``start``/``end``: byte range of each word; ``doc``: its text; ``first``: index of each text's
    first word (n + 1 entries); ``hash``: 64-bit polynomial hash of each word's bytes.
    """

    def __init__(self, blob: np.ndarray, offsets: np.ndarray, kinds: np.ndarray | None = None):
        """``kinds``: kind of each byte value if words also end where the kind changes; 0 is space, and
        each byte of the highest kind is a word of its own."""
        n = len(blob)
        if kinds is None:
            inside = ~_SPACE[blob]
            opens = inside.copy()
            opens[1:] &= ~inside[:-1]
        else:
            kind = kinds[blob]
            inside = kind > 0
            opens = inside & (kind == kinds.max())
            opens[1:] |= inside[1:] & (kind[1:] != kind[:-1])
            opens[:1] = inside[:1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[heads] = inside[heads]
        closes = np.empty(n, bool)
        if n:
            closes[:-1] = inside[:-1] & (~inside[1:] | opens[1:])
            closes[-1] = inside[-1]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        up, down = _powers(n + 1)
        run = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[blob] * up[:n], out=run[1:])
        self.hash = mix((run[self.end] - run[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of every window of ``size`` words inside one text, and the index of its first word."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        h = self.hash[: n - size + 1].copy()
        for k in range(1, size):
            h *= U64(0xAF251AF3B0F025B5)
            h += self.hash[k: n - size + 1 + k]
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1:])
        return mix(h[at]), at


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Join of flat[start[i] : start[i] + size[i]] over i."""
    some = size > 0
    if not some.all():
        start, size = start[some], size[some]
    if not len(size):
        return flat[:0]
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]), np.int64)
    step[0] = start[0]
    step[ends[:-1]] = start[1:] - start[:-1] - size[:-1] + 1
    return flat[np.cumsum(step)]


class HashTable:
    """Open-addressing table from 64-bit keys (not 0) to positions, for lookups of whole arrays."""

    def __init__(self, bits: int):
        self.bits, self.reach, self.size = bits, 1, 0
        self.keys = np.zeros((1 << bits) + 4096, U64)
        self.values = np.full((1 << bits) + 4096, -1, np.int32)

    def _slot(self, keys):
        return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Value of each key, -1 where it is not in the table."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        rest = np.flatnonzero((there != keys) & (there != 0))
        for k in range(1, self.reach):
            if not len(rest):
                break
            at = slot[rest] + k
            there = self.keys[at]
            found = there == keys[rest]
            out[rest[found]] = self.values[at[found]]
            rest = rest[~found & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter distinct keys that are not in the table yet."""
        slot, todo, step = self._slot(keys), np.arange(len(keys)), 0
        self.size += len(keys)
        while len(todo):
            step += 1
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] += 1
        self.reach = max(self.reach, step)


# ---------------------------------------------------------------- ordered chunks of a table

def chunked(df: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Add ``_chunk``: ranges of ids in ascending order, of about ``chunk_bytes`` of text each; and the text's bytes.

    The ranges come from quantiles of all ids (at most 1,024 numbers reach the driver) and are cut
    evenly between two quantiles where more are needed. Rows without id get negative chunks.
    """
    spots = [i / 1024 for i in range(1025)]
    total, rows, q = df.agg(F.sum(F.octet_length(text_col)), F.count("*"), F.percentile_approx(id_col, spots, 10000)).first()
    total = int(total or 0)
    want = max(1, math.ceil(total / chunk_bytes))
    q = q or [0]
    coarse = min(want, 1024)
    bounds = np.array([q[min(len(q) - 1, round(i * (len(q) - 1) / coarse))] for i in range(coarse + 1)], np.int64)
    sub = math.ceil(want / coarse)

    @F.pandas_udf("long")
    def place(ids):
        import pandas as pd

        known = ids.notna().to_numpy()
        v = ids.fillna(bounds[0]).to_numpy().astype(np.int64)
        k = np.clip(np.searchsorted(bounds[1:-1], v, side="right"), 0, len(bounds) - 2)
        if sub > 1:
            width = np.maximum(bounds[k + 1] - bounds[k], 1).astype(float)
            k = k * sub + np.clip(((v - bounds[k]) / width * sub).astype(np.int64), 0, sub - 1)
        return pd.Series(np.where(known, k, -1))

    at = place(F.col(id_col).cast("long"))
    lost = -1 - F.pmod(F.xxhash64(text_col), F.lit(want))
    return df.withColumn("_chunk", at).withColumn("_chunk", F.when(F.col("_chunk") < 0, lost).otherwise(F.col("_chunk"))), total


# ---------------------------------------------------------------- connected components

def components(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """node, comp: smallest node of each connected component, over edges (a, b); nodes without an edge have no row.

    Alternates large-star and small-star steps: each replaces edges by edges to a smaller
    neighbour, so the table never outgrows its input, and each step is written in the shared folder.
    Hubs are safe: minima are partial aggregates, and a join on a hub is split by adaptive execution.
    """
    e, path = scratch.land(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    paths, before = [path], None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e1, p1 = scratch.land(large)
        low = e1.groupBy("a").agg(F.min("b").alias("m"))
        small = (e1.join(low, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        e2, p2 = scratch.land(small)
        scratch.drop(*paths, p1)
        paths = [p2]
        now = e2.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        e = e2
        if now == before:
            break
        before = now
    out = e.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("node"), "comp")
    roots = out.select(F.col("comp").alias("node"), "comp").distinct()
    return out.unionByName(roots), paths
