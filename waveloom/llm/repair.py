"""Token files in a grammar-compressed binary format: Re-Pair per block of documents, random-access decoding."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import U64, Scratch, gather, table, utf8

MAGIC = b"RPG1"
_HEAD = struct.Struct("<4sIIIIII")  # magic, first nonterminal, rules, symbols, texts, rounds, reserved


# ---------------------------------------------------------------- grammar

def compress(ids: np.ndarray, last: np.ndarray, terminals: int, min_count: int = 16, shrink: int = 32):
    """Repeatedly replace frequent id pairs by nonterminals.

    Each round counts all adjacent pairs, takes every pair at least as frequent as the round's
    threshold (the highest count, divided by ``shrink`` each round, down to ``min_count``), and replaces
    its occurrences from the most frequent pair down; where two chosen pairs overlap, the more
    frequent one wins. Rounds at the lowest threshold count the pairs that hold a nonterminal of the round
    before, as only those can have become frequent. ``last`` marks the final id of each text: no pair
    crosses it, so each text stays decodable by itself. Ends when no such pair occurs ``min_count`` times.

    Returns symbols, last marks of the symbols, rules [n, 2], and the number of rules per round.
    """
    seq, last = ids.astype(np.uint32), last.copy()
    rules, rounds, nxt, limit, newest = [], [], terminals, None, 0
    while len(seq) > 1:
        if limit == min_count:  # only pairs with a symbol of the round before can have become frequent
            new = seq >= newest
            look = np.flatnonzero((new[:-1] | new[1:]) & ~last[:-1])
            key = (seq[look].astype(U64) << U64(32)) | seq[look + 1]
        else:
            look, key = None, (seq[:-1].astype(U64) << U64(32)) | seq[1:]
        if not len(key):
            break
        bits = max(10, int(len(key) * 2 - 1).bit_length())
        slot = ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int32)
        often = np.bincount(slot, minlength=1 << bits)[slot] >= min_count  # at most the pairs of a slot: none is missed
        if look is None:
            often &= ~last[:-1]
            look = often = np.flatnonzero(often)
        else:
            often = np.flatnonzero(often)
            look = look[often]
        if not len(often):
            break
        key, slot = key[often], slot[often]
        ordered = np.sort(key)
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(heads, len(ordered)))
        top = int(counts.max())
        if top < min_count:
            break
        limit = max(min_count, (top if limit is None else min(limit, top)) // shrink)
        chosen = counts >= limit
        pairs, counts = ordered[heads[chosen]], counts[chosen]
        # rank of each occurrence's pair: by a slot table, and by search where two chosen pairs share a slot
        by_count = np.argsort(-counts, kind="stable")
        rank_of = np.empty(len(pairs), np.int32)
        rank_of[by_count] = np.arange(len(pairs), dtype=np.int32)
        place = np.full(1 << bits, -1, np.int32)
        place[((pairs * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)] = np.arange(len(pairs), dtype=np.int32)
        spot = place[slot]
        some = np.flatnonzero(spot >= 0)
        spot, key, pos = spot[some], key[some], look[some]
        hit = pairs[spot] == key
        other = np.flatnonzero(~hit)
        if len(other):
            found = np.minimum(np.searchsorted(pairs, key[other]), len(pairs) - 1)
            spot[other], hit[other] = found, pairs[found] == key[other]
        pos, rank = pos[hit], rank_of[spot[hit]]
        pairs = pairs[by_count]
        joined = np.diff(pos) == 1
        before = np.concatenate([[False], joined])
        after = np.concatenate([joined, [False]])
        rank_before = np.concatenate([[-1], rank[:-1]])
        rank_after = np.append(rank[1:], -1)
        same = before & (rank_before == rank)
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(pos))))
        wins = ~before | (rank < rank_before)  # against the pair before, at the start of a run of one pair
        take = wins[start] & ((np.arange(len(pos)) - start) % 2 == 0) & (~after | (rank <= rank_after))
        used = np.bincount(rank[take], minlength=len(pairs))
        good = used >= 2
        take &= good[rank]
        if not take.any():
            if limit == min_count:
                break
            newest = nxt
            continue
        number = np.cumsum(good) - 1 + nxt
        fresh = pairs[good]
        rules.append(np.stack([fresh >> U64(32), fresh & U64(0xFFFFFFFF)], 1).astype(np.uint32))
        rounds.append(len(fresh))
        newest = nxt
        nxt += len(fresh)
        where = pos[take]
        seq[where] = number[rank[take]]
        last[where] = last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last = seq[keep], last[keep]
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.array(rounds, np.uint32)


class Block:
    """One encoded block: header, rules, rule counts per round, expansion lengths, first symbol of each text, symbols."""

    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, n_symbols, n_texts, n_rounds, _ = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a grammar block")
        at = _HEAD.size

        def read(n):
            nonlocal at
            out = np.frombuffer(data, "<u4", n, at)
            at += 4 * n
            return out

        self.rules, self.rounds, self.lengths = read(2 * n_rules).reshape(-1, 2), read(n_rounds), read(n_rules)
        self.first, self.symbols = read(n_texts + 1).astype(np.int64), read(n_symbols)
        self._flat = None

    @staticmethod
    def encode(ids: np.ndarray, sizes: np.ndarray, terminals: int, **options) -> bytes:
        last = np.zeros(len(ids), bool)
        ends = np.cumsum(sizes)
        last[ends[sizes > 0] - 1] = True
        seq, closes, rules, rounds = compress(ids, last, terminals, **options)
        lengths = np.ones(terminals + len(rules), np.uint32)
        done = 0
        for n in rounds:
            part = rules[done: done + n]
            lengths[terminals + done: terminals + done + n] = lengths[part[:, 0]] + lengths[part[:, 1]]
            done += int(n)
        full = np.flatnonzero(closes) + 1
        first = np.zeros(len(sizes) + 1, np.uint32)
        first[1:] = np.concatenate([[0], full])[np.cumsum(sizes > 0)]
        head = _HEAD.pack(MAGIC, terminals, len(rules), len(seq), len(sizes), len(rounds), 0)
        return b"".join([head, rules.tobytes(), rounds.tobytes(), lengths[terminals:].tobytes(), first.tobytes(), seq.tobytes()])

    def _expanded(self):
        """Expansions of all symbols in one array, with their starts and lengths."""
        if self._flat is None:
            t, n = self.terminals, len(self.rules)
            size = np.concatenate([np.ones(t, np.int64), self.lengths.astype(np.int64)])
            start = np.concatenate([np.arange(t), t + np.concatenate([[0], np.cumsum(size[t:])[:-1]]) if n else np.zeros(0, np.int64)]).astype(np.int64)
            flat = np.empty(t + int(size[t:].sum()), np.uint32)
            flat[:t] = np.arange(t)
            done = 0
            for k in self.rounds.astype(int):
                kids = self.rules[done: done + k].ravel().astype(np.int64)
                lo = start[t + done]
                out = gather(flat, start[kids], size[kids])
                flat[lo: lo + len(out)] = out
                done += k
            self._flat = flat, start, size
        return self._flat

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids of texts lo to hi - 1 of the block, without touching the others' symbols."""
        flat, start, size = self._expanded()
        hi = len(self.first) - 1 if hi is None else hi
        part = self.symbols[self.first[lo]: self.first[hi]].astype(np.int64)
        return gather(flat, start[part], size[part])

    def sizes(self) -> np.ndarray:
        """Number of ids of each text."""
        _, _, size = self._expanded()
        run = np.concatenate([[0], np.cumsum(size[self.symbols])])
        return run[self.first[1:]] - run[self.first[:-1]]


# ---------------------------------------------------------------- files

def write_files(docs: DataFrame, path: str, vocabulary: bytes, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                block_ids: int = 1 << 20, min_count: int = 16) -> None:
    """Encode whole texts in ascending id order and write grammar blocks as a Parquet table at ``path``.

    Row: part (range of ids), block (order inside the part), n_ids, doc_ids (packed integers), known
    (packed bits: id is not null), data (the block). Parquet is the container so that any store Spark
    can write to will do and a lost task is written again whole. Null and empty texts hold the end id
    alone; null ids come first. A block ends after the text with which it has ``block_ids`` ids.
    """
    box = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file, a few MB

    def encode(batches):
        from pyspark import TaskContext

        coder, part = wordbpe.load(box.value), TaskContext.get().partitionId()
        ids, sizes, keys, held, block = [], [], [], 0, 0

        def close():
            nonlocal ids, sizes, keys, held, block
            ends, seq = pa.concat_arrays(keys), np.concatenate(ids)
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": [len(seq)],
                "doc_ids": [ends.fill_null(0).to_numpy().astype("<i8").tobytes()], "known": [np.packbits(ends.is_valid().to_numpy(zero_copy_only=False)).tobytes()],
                "data": [Block.encode(seq, np.concatenate(sizes), max(coder.size, end_id + 1), min_count=min_count)]})
            ids, sizes, keys, held, block = [], [], [], 0, block + 1
            return row

        for batch in batches:
            texts = utf8(batch.column(batch.schema.get_field_index(text_col)))
            own = batch.column(batch.schema.get_field_index(id_col))
            for lo in range(0, len(texts), 512):
                flat, n = coder.encode_arrow(texts.slice(lo, 512), end_id)
                done = 0
                while done < len(n):  # whole texts up to the first with which the block is full
                    run = np.cumsum(n[done:])
                    m = min(len(run), int(np.searchsorted(run, block_ids - held)) + 1)
                    begin = int(n[:done].sum())
                    ids.append(flat[begin: begin + int(run[m - 1])])
                    sizes.append(n[done: done + m])
                    keys.append(own.slice(lo + done, m))
                    held += int(run[m - 1])
                    done += m
                    if held >= block_ids:
                        yield close()
        if keys:
            yield close()

    dealt = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    dealt.mapInArrow(encode, "part int, block int, n_ids long, doc_ids binary, known binary, data binary").write.parquet(path)


def read_files(spark, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per text: id, start (ids of all texts before it), n_tokens, ids_crc32, all from the files."""
    blocks = spark.read.parquet(path)

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(j)[k].as_py() for j, c in enumerate(batch.schema.names)}
                block = Block(row["data"])
                keys = np.frombuffer(row["doc_ids"], "<i8")
                known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=len(keys)).astype(bool)
                sizes = block.sizes()
                ends = np.cumsum(sizes)
                raw = memoryview(block.ids().astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    id_col: pa.array(keys, mask=~known), "part": np.full(len(keys), row["part"], np.int32), "block": np.full(len(keys), row["block"], np.int32),
                    "inside": ends - sizes, "n_tokens": sizes, "ids_crc32": np.array(sums, np.int64)})

    texts = blocks.select("part", "block", "doc_ids", "known", "data").mapInArrow(
        decode, f"{id_col} long, part int, block int, inside long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("part", "block", "n_ids")
    # totals per part, one row each: as many as the writer had tasks
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "block", inside.alias("earlier")).join(ahead, "part").select("part", "block", (F.col("ahead") + F.col("earlier")).alias("begin"))
    return texts.join(starts, ["part", "block"]).select(id_col, (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        vocabulary = f.read()
    path = f"{Scratch(spark).root}/tokens"
    write_files(table(spark, sf_dir, "documents"), path, vocabulary)
    return read_files(spark, path)
