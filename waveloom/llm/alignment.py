"""Alignment of two tokenizers' tokens of the same texts, by pointer jumping over overlapping tokens."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, gather, slices, table, utf8, utf8_bytes

#: fixed value: how the byte-level vocabulary cuts texts before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters whose class (letter, number, space) every version of Unicode agrees on
_SETTLED = regex.compile(r"[\t\n\r\x20-\x7E¡-ɏ]*+\Z")
#: bytes of chunks that a task holds while it writes or reads them
_GROUP = 8 << 20
_LOADED: dict[int, Pair] = {}


def load(files: tuple[bytes, bytes]) -> Pair:
    """One instance per worker process and pair of vocabulary files."""
    key = zlib.crc32(files[1], zlib.crc32(files[0]))
    if key not in _LOADED:
        _LOADED[key] = Pair(*files)
    return _LOADED[key]


def _flat(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, entries), np.int64, len(entries))
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(size) - size, size


class Pair:
    """Encoders of a byte-level vocabulary (A) and a piece vocabulary (B), and the bytes of every id.

    A's ids come from merge ranks where the file's ids are in the order of its merges and the text has only
    characters that are classed alike everywhere, else from the tokenizers library; B's from the sentencepiece library.
    """

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        # the vocabulary writes printable bytes as themselves and the others as letters from U+0100 on
        shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k <= 255]
        letter = {chr(k): k for k in shown} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in shown)}
        vocab = self.a.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            entries[i] = bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()
        self.a_bytes = _flat(entries)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = _flat([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        spec = json.loads(a_file)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        special = {t["id"] for t in spec.get("added_tokens", [])}
        ranks = {entries[i]: i for t, i in model["vocab"].items() if i not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        plain = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
                 and merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged))
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain else None
        most = max(len(entries), len(pieces))
        self.words = _flat([f"{i}{s}".encode() for i in range(most) for s in ",|;"])
        self.n_b = len(pieces)
        self.code = np.uint32 if len(entries) * self.n_b < 2**32 else np.int64

    def encode(self, texts: list[str]) -> tuple[list, list]:
        """Ids of each text by A (of a blank and the text) and by B."""
        spaced = [" " + t for t in texts]
        settled = [self.ranked is not None and _SETTLED.match(t) is not None for t in spaced]
        rest = iter(self.a.encode_batch([t for t, s in zip(spaced, settled, strict=True) if not s], add_special_tokens=False))
        a = [self.ranked.encode_ordinary(t) if s else next(rest).ids for t, s in zip(spaced, settled, strict=True)]
        return a, self.b.encode(texts, num_threads=1)

    def align(self, texts: list[str], blob: np.ndarray, size: np.ndarray):
        """n_a, n_b, n_groups, n_links and digest of each text (arrays and a list), and the id pairs of all links in a row.

        ``blob`` and ``size``: bytes of the texts in a row, and of each one. No text is empty.
        """
        a, b = self.encode(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int32, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        # blank and text, as bytes
        size = size + 1
        stop = np.cumsum(size)
        want = np.empty(int(stop[-1]), np.uint8)
        there = np.ones(len(want), bool)
        there[stop - size] = False
        want[~there], want[there] = 32, blob
        good = self._same(ids_a, n_a, self.a_bytes, want, size) & self._same(ids_b, n_b, self.b_bytes, want, size)
        if not good.all():
            ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
            n_a, n_b, size = n_a * good, n_b * good, size * good
            stop = np.cumsum(size)
        total = int(stop[-1])
        end_a, end_b = (np.cumsum(x[2][i]) for x, i in ((self.a_bytes, ids_a), (self.b_bytes, ids_b)))
        is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        is_a[end_a], is_b[end_b] = True, True
        to_a, to_b = (np.cumsum(x, dtype=np.int32) - x for x in (is_a, is_b))  # at a byte's end: the token that holds the byte

        # every token points to the overlapping token that reaches farthest; the A token at a common end points to itself
        count_a = len(ids_a)
        after = np.concatenate([np.where(is_b[end_a], np.arange(count_a, dtype=np.int32), to_b[end_a] + np.int32(count_a)), to_a[end_b]])
        while True:
            twice = after[after]
            if np.array_equal(twice, after):
                break
            after = twice
        last = np.zeros(count_a, bool)
        last[after] = True
        group = (np.cumsum(last) - last)[after]  # number of the component, in order

        in_a, in_b = group[:count_a], group[count_a:]
        groups = int(last.sum())
        up_to_a, up_to_b = np.cumsum(np.bincount(in_a, minlength=groups)), np.cumsum(np.bincount(in_b, minlength=groups))
        place_a = np.arange(count_a) + np.concatenate([[0], up_to_b])[in_a]
        place_b = np.arange(len(ids_b)) + up_to_a[in_b]
        word = np.empty(count_a + len(ids_b), np.int64)
        word[place_a], word[place_b] = ids_a * 3, ids_b * 3
        if groups:
            word[place_a[up_to_a - 1]] += 1  # "|" after the last A token of a group, ";" after its last B token
            word[place_b[up_to_b - 1]] += 2
        flat, start, width = self.words
        out = gather(flat, start[word], width[word])
        cut = np.concatenate([[0], np.cumsum(width[word])])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
        view = memoryview(out)
        digest = [hashlib.sha256(view[s: e - 1]).hexdigest() if e > s else "" for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

        # one link per byte range between two ends of either kind
        ends = np.flatnonzero(is_a | is_b)
        pairs = ids_a[to_a[ends]].astype(self.code) * self.code(self.n_b) + ids_b[to_b[ends]].astype(self.code)
        bounds = np.concatenate([[0], stop])
        n_links = np.diff(np.searchsorted(ends, bounds, side="right"))
        n_groups = np.diff(np.searchsorted(end_a[last], bounds, side="right"))
        return n_a, n_b, n_groups, n_links, digest, pairs

    @staticmethod
    def _same(ids, count, entries, want, size) -> np.ndarray:
        """Whether the joined bytes of each text's ids are the wanted ones."""
        flat, start, width = entries
        got = np.concatenate([[0], np.cumsum(width[ids])])[np.concatenate([[0], np.cumsum(count)])]
        made = gather(flat, start[ids], width[ids])
        same = np.diff(got) == size
        if same.all():
            if not np.array_equal(made, want):
                stop = np.cumsum(size)
                wrong = np.concatenate([[0], np.cumsum(made != want)])
                same = wrong[stop] == wrong[stop - size]
            return same
        stop = np.cumsum(size)
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(made[got[k]: got[k + 1]], want[stop[k] - size[k]: stop[k]])
        return same


def align(df: DataFrame, files: tuple[bytes, bytes], chunk_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``df``.

    Tokens of both vocabularies that overlap form groups. A link is a pair of overlapping tokens; its count is the number of
    links of the whole table with its two ids. n_best: links whose count is the highest of their B id, ties
    included. count_sum: sum of the links' counts.

    Null and empty texts, and texts whose joined token bytes differ from a blank and the text, have zeros and ''. Repeated
    rows and rows with a null id count like any other. An empty table gives no rows. Other columns are not read.

    Rows are worked in chunks of about ``chunk_bytes`` of text (a longer text is a chunk of its own; its arrays are bounded
    by its length). A chunk is encoded once and written with the places of its links in its list of distinct id pairs; files hold
    few chunks per row group, so the memory of a task does not grow with the number of its chunks. The
    lists are summed by pair; each pair goes back once to each chunk that has it. So texts and links never move,
    and a pair that all texts share is one row per chunk. The highest count per B id is a table of one row
    per entry of B's vocabulary.
    """
    import sentencepiece

    spark = df.sparkSession
    scratch = Scratch(spark)
    box = spark.sparkContext.broadcast(files)  # two vocabulary files, a few MB
    kind = df.schema[id_col].dataType.simpleString()
    wide = pa.list_(pa.int64())
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def encode(batches):
        pair = load(box.value)
        for batch in batches:
            texts = utf8(batch.column(1))
            blob, off = utf8_bytes(texts)
            for lo, hi in slices(off, chunk_bytes):
                size = np.diff(off[lo: hi + 1])
                some = np.flatnonzero(size > 0)
                cols = {k: np.zeros(hi - lo, np.int64) for k in counts}
                digest, found = [""] * (hi - lo), [np.zeros(0, pair.code)]
                at = np.concatenate([[0], np.cumsum(size[some])])
                part = blob[off[lo]: off[hi]]
                for s, e in slices(at, 1 << 19):
                    rows = some[s:e]
                    *got, words, links = pair.align(texts.take(pa.array(rows + lo)).to_pylist(), part[at[s]: at[e]], size[rows])
                    for k, v in zip(counts, got, strict=True):
                        cols[k][rows] = v
                    for r, w in zip(rows.tolist(), words, strict=True):
                        digest[r] = w
                    found.append(links)
                pairs, spot, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
                spot = spot.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
                one = lambda v, t: pa.array([v], t)
                yield pa.RecordBatch.from_pydict({
                    "chunk": one(uuid.uuid4().int >> 65, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo)),
                    **{k: one(v, wide) for k, v in cols.items()}, "digest": one(digest, pa.list_(pa.string())), "spot": one(spot.tobytes(), pa.binary()), "width": one(spot.itemsize, pa.int32()),
                    "pairs": one(pairs.astype(np.int64), wide), "times": one(times, wide)})

    n_b = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    chunks, _ = scratch.land(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        encode, f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, spot binary, width int, pairs array<long>, times array<long>"), _GROUP)
    lists = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    total, _ = scratch.land(lists.groupBy("pair").agg(F.sum("times").alias("count")))
    most = total.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("count").alias("most"))
    total = total.withColumn("b", F.col("pair") % n_b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = lists.select("chunk", "pair").join(total, "pair").select(F.col("chunk").alias("of"), "pair", "count", "best")

    def score(own: pa.Table, known: pa.Table) -> pa.Table:
        rows = []
        for k in range(own.num_rows):
            r = {c: own.column(c).combine_chunks()[k] for c in own.column_names}
            order = np.argsort(known.column("pair").to_numpy())
            count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy(zero_copy_only=False)[order]
            spot = np.frombuffer(r["spot"].as_py(), np.uint16 if r["width"].as_py() == 2 else np.uint32)
            n_links = r["n_links"].values.to_numpy()
            cut = np.concatenate([[0], np.cumsum(n_links)])
            sums = [np.concatenate([[0], np.cumsum(x[spot], dtype=np.int64)]) if len(spot) else np.zeros(1, np.int64) for x in (best, count)]
            rows.append(pa.table({"id": r["ids"].values, **{c: r[c].values for c in counts}, "n_best": sums[0][cut[1:]] - sums[0][cut[:-1]],
                                  "count_sum": sums[1][cut[1:]] - sums[1][cut[:-1]], "groups_sha256": r["digest"].values}))
        return pa.concat_tables(rows)

    own = chunks.drop("pairs", "times")
    out = own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(
        score, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(public_tokenizers.path(name), "rb") as f:
            files.append(f.read())
    return align(table(spark, sf_dir, "documents"), (files[0], files[1]))
