"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chunked, mix, slices, text_from_bytes, utf8, utf8_bytes

#: bytes of text whose hashes are held at once while words are scanned
SCAN = 1 << 20


def _hashes(blob: np.ndarray, offsets: np.ndarray, window: int):
    """All window hashes of a chunk with text and first word of each, and the word counts per text."""
    hs, docs, at, counts = [], [], [], []
    base = 0
    for lo, hi in slices(offsets, SCAN):
        w = Words(blob[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
        h, first = w.windows(window)
        hs.append(h)
        docs.append((w.doc[first] + lo).astype(np.int32))
        at.append(first + base)
        counts.append(w.count)
        base += len(w.hash)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(hs, U64), cat(docs, np.int32), cat(at, np.int64), cat(counts, np.int64)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Gaps of ascending hashes as byte planes; the upper planes are small numbers and compress well."""
    gaps = np.diff(sorted_hashes, prepend=U64(0))
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def _bucket_cuts(unique: np.ndarray, buckets: int) -> np.ndarray:
    """Where the ascending hashes pass from one bucket (equal range of hash values) to the next."""
    edges = np.array([((k << 64) // buckets) for k in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(unique, edges), [len(unique)]])


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   chunk_bytes: int = 8 << 20, bucket_windows: int = 2_000_000, tidy: bool = True) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts in a text with a smaller id.

    Words are runs of characters other than ASCII white space, unchanged. Windows are judged on the
    input. Overlapping repeated windows merge into maximal removal intervals. Returns the input's
    columns with the text replaced by the kept words (joined by one space) and ``_n_words``,
    ``_n_removed``. Without ``tidy``, texts that lose no word stay as they are.

    Null text stays null with zero words; texts shorter than a window lose nothing; rows with equal
    ids never remove from each other; rows with a null id lose nothing and remove nothing. Other
    columns pass through under their own names; ``_chunk``, ``_n_words`` and ``_n_removed`` are taken.

    Rows are dealt in ascending id ranges ("chunks"), so the smallest holder of a window lies in the
    smallest chunk that has it, and only (hash, chunk) has to be compared. A chunk sends its distinct
    hashes once, packed, to the owner of each range of hash values; the owner answers one bit per
    hash: seen in a smaller chunk or not. A window in a third of all texts is one hash per chunk there.
    Two different windows are taken for one with probability 2^-64 each.
    """
    dealt, total = chunked(docs, id_col, text_col, chunk_bytes)
    buckets = max(1, math.ceil(total / 6 / bucket_windows))
    big = pa.large_string()

    def send(t: pa.Table) -> pa.Table:
        chunk = t.column("_chunk")[0].as_py()
        rows = {"_bucket": [], "_chunk": [], "n": [], "data": []}
        if chunk >= 0:
            h, *_ = _hashes(*utf8_bytes(utf8(t.column(text_col).cast(big))), window)
            u = np.unique(h)
            cuts = _bucket_cuts(u, buckets)
            for b in range(buckets):
                if cuts[b + 1] > cuts[b]:
                    part = u[cuts[b]: cuts[b + 1]]
                    for name, v in zip(rows, (b, chunk, len(part), _pack(part)), strict=True):
                        rows[name].append(v)
        return pa.table(rows, schema=pa.schema([("_bucket", pa.int64()), ("_chunk", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))

    def answer(t: pa.Table) -> pa.Table:
        chunk, n = t.column("_chunk").to_numpy(), t.column("n").to_numpy()
        order = np.argsort(chunk, kind="stable")
        sizes = n[order]
        h = np.concatenate([_unpack(t.column("data")[int(i)].as_py(), int(n[i])) for i in order])
        by = np.argsort(h, kind="stable")
        seen = np.zeros(len(h), bool)
        seen[by[1:]] = h[by[1:]] == h[by[:-1]]
        ends = np.cumsum(sizes)
        flags = [np.packbits(seen[e - s: e]).tobytes() for s, e in zip(sizes, ends, strict=True)]
        return pa.table({"_chunk": chunk[order], "_bucket": np.full(len(order), t.column("_bucket")[0].as_py(), np.int64),
                         "n": sizes, "flags": pa.array(flags, pa.binary())})

    kept = [c for c in docs.columns if c != text_col]

    def judge(t: pa.Table, answers: pa.Table) -> pa.Table:
        column = t.column(text_col)
        blob, offsets = utf8_bytes(utf8(column.cast(big)))
        ids = t.column(id_col).to_numpy(zero_copy_only=False)
        h, doc, at, counts = _hashes(blob, offsets, window)
        covered = np.zeros(int(counts.sum()) + 1, np.int64)
        if len(h) and t.column("_chunk")[0].as_py() >= 0:
            bucket = answers.column("_bucket").to_numpy()
            earlier = np.concatenate([np.unpackbits(np.frombuffer(answers.column("flags")[int(i)].as_py(), np.uint8),
                                                    count=answers.column("n")[int(i)].as_py()) for i in np.argsort(bucket)]).astype(bool)
            by = np.argsort(h, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], h[by[1:]] != h[by[:-1]]]))
            least = np.minimum.reduceat(ids[doc[by]], heads)
            size = np.diff(np.append(heads, len(h)))
            gone = np.repeat(earlier, size) | (ids[doc[by]] > np.repeat(least, size))
            first = at[by[gone]]
            np.add.at(covered, first, 1)
            np.add.at(covered, first + window, -1)
        stay = np.cumsum(covered[:-1]) == 0
        texts, offs, removed, base = [], [0], [], 0
        for lo, hi in slices(offsets, SCAN):
            part = blob[offsets[lo]: offsets[hi]].copy()
            cut = offsets[lo: hi + 1] - offsets[lo]
            w = Words(part, cut)
            here = stay[base: base + len(w.start)]
            base += len(w.start)
            k = np.flatnonzero(here)
            mask = np.zeros(len(part) + 1, np.int8)
            mask[w.start[k]] += 1
            np.subtract.at(mask, w.end[k], 1)
            mask = np.cumsum(mask[:-1]).astype(bool)
            between = k[:-1][w.doc[k[:-1]] == w.doc[k[1:]]]  # a kept word with a kept one after it in its text
            mask[w.end[between]] = True
            part[w.end[between]] = 32
            cuts = np.bincount(w.doc[~here], minlength=hi - lo)
            if not tidy:
                whole = np.repeat(cuts == 0, np.diff(cut))
                mask |= whole
                part[whole] = blob[offsets[lo]: offsets[hi]][whole]
            texts.append(part[mask])
            place = np.concatenate([[0], np.cumsum(mask)])
            offs.extend((place[cut[1:]] + offs[-1]).tolist())
            removed.append(cuts)
        out = text_from_bytes(np.concatenate(texts) if texts else np.zeros(0, np.uint8), np.array(offs), ~column.combine_chunks().is_null().to_numpy(zero_copy_only=False))
        cols = {c: t.column(c) for c in kept} | {text_col: out.cast(pa.string()) if len(out) == 0 or offs[-1] < 2**31 else out,
                                                 "_n_words": counts, "_n_removed": np.concatenate(removed) if removed else np.zeros(0, np.int64)}
        return pa.table(cols)

    sent = dealt.groupBy("_chunk").applyInArrow(send, "_bucket long, _chunk long, n long, data binary")
    answers = sent.groupBy("_bucket").applyInArrow(answer, "_chunk long, _bucket long, n long, flags binary")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    schema += f", `{text_col}` string, _n_words long, _n_removed long"
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(judge, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
