"""SentencePiece encoding for merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, table, utf8

MARK = "▁"  # stands for a space inside pieces
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_HALF = 120_000
_LONG = 64
_NEVER = np.int32(2**31 - 1)

_LOADED: dict[int, PieceCodec] = {}


def load(data: bytes) -> PieceCodec:
    """One instance per worker process and model file."""
    key = zlib.crc32(data)
    if key not in _LOADED:
        _LOADED[key] = PieceCodec(data)
    return _LOADED[key]


class PieceCodec:
    """Encode and decode texts with the pieces and scores of a merge-type model with byte fallback.

    A text is its characters with spaces as marks, after one leading mark. All adjacent pairs whose
    join is a piece stand on an agenda; the pair with the highest score is joined (the leftmost of
    equal ones), its neighbours' pairs are entered anew, until the agenda is empty. Characters that
    are no piece become their UTF-8 bytes. No piece holds a mark after another character, so the
    agenda of a text falls apart into the agendas of its units (marks and what follows them); units
    are worked in batches, one merge of every unit at a time, and kept in a bounded cache. Every unit
    is compared with the sentencepiece library when it enters the cache; a difference raises.
    """

    def __init__(self, data: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(data)
        norm = model.normalizer_spec
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        kinds = {p.type for p in model.pieces}
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or norm.precompiled_charsmap or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix
                or not kinds <= {1, 2, 3, 6} or any(MARK in p.lstrip(MARK) for p in normal)):
            raise ValueError("needs a merge-type model with byte fallback, without normalisation, whose pieces do not cross spaces")
        self.size = len(model.pieces)
        scores = np.array([p.score for p in model.pieces])
        self.byte = [self.library.piece_to_id(f"<0x{k:02X}>") for k in range(256)]
        # symbols: pieces by id, then characters that occur in pieces but are none themselves; other characters are negative
        extra = sorted({c for p in normal for c in p} - set(normal))
        symbol = normal | {c: self.size + k for k, c in enumerate(extra)}
        self.extra = extra
        self.char = -2 - np.arange(0x110000, dtype=np.int32)
        for p, s in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = s
        ranks = np.unique(-scores[list(normal.values())])
        self.rank = np.full(self.size, _NEVER, np.int32)
        ids = np.fromiter(normal.values(), np.int64)
        self.rank[ids] = np.searchsorted(ranks, -scores[ids])
        self.pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    self.pairs[(left, right)] = i
        # the same pairs in an open-addressing table, for lookups of whole arrays
        self.bits = max(12, int(8 * len(self.pairs)).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, -1, np.int32)
        key = np.array([(a << 24) | b for a, b in self.pairs], np.int64)
        value = np.fromiter(self.pairs.values(), np.int32)
        slot = self._slot(key)
        todo = np.arange(len(key))
        self.reach = 0
        while len(todo):
            free = self.keys[slot[todo]] == -1
            put = todo[free]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] += 1
            self.reach += 1
        self.numbers = list(range(self.size))
        self.texts = [str(k) for k in self.numbers]
        self.cache: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _slot(self, key):
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece that two symbols make, or -1."""
        key = (left.astype(np.int64) << 24) | right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.values[slot], -1)
        rest = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for k in range(1, self.reach):
            if not len(rest):
                break
            there = self.keys[slot[rest] + k]
            found = there == key[rest]
            out[rest[found]] = self.values[slot[rest[found]] + k]
            rest = rest[~found & (there != -1)]
        return out

    # ---- agendas

    def _agendas(self, units: list[str]) -> list[np.ndarray]:
        """Symbols of each unit; all units' agendas advance together, one merge of each per step."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        sym = self.char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        unit = np.repeat(np.arange(len(units)), sizes)
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            made[:-1] = self._joined(sym[:-1], sym[1:])
            made[:-1][unit[:-1] != unit[1:]] = -1
        rank = np.where(made >= 0, self.rank[made], _NEVER)
        done_sym, done_unit = [], []
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            size = np.diff(np.append(heads, len(sym)))
            best = np.minimum.reduceat(rank, heads)
            ended = best == _NEVER
            if ended.any():
                out = np.repeat(ended, size)
                done_sym.append(sym[out])
                done_unit.append(unit[out])
                sym, unit, made, rank = sym[~out], unit[~out], made[~out], rank[~out]
                size, best = size[~ended], best[~ended]
                if not len(sym):
                    break
            top = np.flatnonzero(rank == np.repeat(best, size))
            top = top[np.concatenate([[True], unit[top[1:]] != unit[top[:-1]]])]  # the leftmost of each unit
            sym[top] = made[top]
            made[top] = made[top + 1]  # replaced below; keeps the end of a unit closed
            keep = np.ones(len(sym), bool)
            keep[top + 1] = False
            at = top - np.arange(len(top))
            sym, unit, made, rank = sym[keep], unit[keep], made[keep], rank[keep]
            anew = np.concatenate([at, at[at > 0] - 1])
            anew = anew[anew < len(sym) - 1]
            m = self._joined(sym[anew], sym[anew + 1])
            m[unit[anew] != unit[anew + 1]] = -1
            made[anew] = m
            rank[anew] = np.where(m >= 0, self.rank[m], _NEVER)
            if len(at) and at[-1] == len(sym) - 1:
                made[-1], rank[-1] = -1, _NEVER
        sym, unit = np.concatenate(done_sym or [sym]), np.concatenate(done_unit or [unit])
        by = np.argsort(unit, kind="stable")
        sym, count = sym[by], np.bincount(unit, minlength=len(units))
        return np.split(sym, np.cumsum(count)[:-1])

    def _agenda(self, unit: str) -> list[int]:
        """Symbols of one long unit: the agenda is a heap, the symbols a linked list."""
        sym = self.char[np.frombuffer(unit.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def enter(i):
            j = after[i]
            if j < n and (p := self.pairs.get((sym[i], sym[j]))) is not None:
                heapq.heappush(agenda, (int(self.rank[p]), i, sym[i], j, sym[j], p))

        for i in range(n - 1):
            enter(i)
        while agenda:
            _, i, a, j, b, p = heapq.heappop(agenda)
            if sym[i] != a or after[i] != j or sym[j] != b:
                continue  # one of the two has been joined meanwhile
            sym[i], sym[j], after[i] = p, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                enter(before[i])
            enter(i)
        return [s for s in sym if s is not None]

    def _ids(self, symbols) -> tuple:
        out = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(self.numbers[s])
            else:
                c = self.extra[s - self.size] if s >= 0 else chr(-2 - s)
                out += [self.byte[b] for b in c.encode()]
        return tuple(out)

    def _learn(self, keys: list[str]) -> None:
        """Cache units; a key is a unit without its first mark."""
        short = [k for k in keys if len(k) < _LONG]
        found = dict(zip(short, self._agendas([MARK + k for k in short]), strict=True)) if short else {}
        got = {k: self._ids(found[k].tolist() if k in found else self._agenda(MARK + k)) for k in keys}
        check = [k for k in keys if k]  # the library has no ids for an empty text; the unit of one mark alone is part of longer checks
        for k, want in zip(check, self.library.encode(check, num_threads=1), strict=True):
            if list(got[k]) != want:
                raise AssertionError(f"agenda and library differ on {k!r}: {got[k]} and {want}")
        texts = self.texts
        self.cache.update((k, (v, ",".join([texts[i] for i in v]))) for k, v in got.items())

    def _units(self, text: str) -> list[str]:
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u[1:] for u in _UNIT.findall(MARK + text.replace(" ", MARK))]

    def encode(self, texts: list[str]) -> list[list[tuple]]:
        """For each text, (ids, ids as text) of its units in order; an empty text has none."""
        if len(self.cache) > _HALF:
            self.older, self.cache = self.cache, {}
        units = [self._units(t) if t else [] for t in texts]
        cache, older = self.cache, self.older
        new = dict.fromkeys(u for x in units for u in x if u not in cache)
        if new:
            again = {u: older[u] for u in new if u in older}
            cache.update(again)
            fresh = [u for u in new if u not in again]
            if fresh:
                self._learn(fresh)
        get = cache.get
        return [list(map(get, x)) for x in units]


def tokenize(df: DataFrame, model: bytes, outputs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts: the id column and any of ``outputs``:

    ids (array<int>), n_tokens, decoded (the library's decode of the ids), ids_sha256 (of the decimal ids
    joined by commas), decoded_sha256 (both lower-case hex). Digests are taken where the ids are, so
    that a caller who wants digests moves no ids.

    Null and empty texts have no ids and decode to an empty text. Repeated rows are encoded alike; a
    null id passes through; other columns are not read. Nothing is shuffled; texts are worked
    in runs of 128, so memory is bounded by the longest text and the unit cache (240,000 units).
    """
    types = {"ids": "array<int>", "n_tokens": "long", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    box = df.sparkSession.sparkContext.broadcast(model)  # one model file, under a few MB

    def work(batches):
        codec = load(box.value)
        for batch in batches:
            names = batch.schema.names
            texts = utf8(batch.column(names.index(text_col))).to_pylist()
            keys = batch.column(names.index(id_col))
            for lo in range(0, len(texts), 128):
                found = codec.encode(texts[lo: lo + 128])
                ids = [list(chain.from_iterable([u[0] for u in x])) for x in found]
                cols: dict = {id_col: keys.slice(lo, len(found))}
                decoded = codec.library.decode(ids, num_threads=1) if any(o.startswith("decoded") for o in outputs) else None
                for o in outputs:
                    if o == "ids":
                        cols[o] = pa.array(ids, pa.list_(pa.int32()))
                    elif o == "n_tokens":
                        cols[o] = pa.array([len(x) for x in ids], pa.int64())
                    elif o == "decoded":
                        cols[o] = pa.array(decoded, pa.string())
                    elif o == "ids_sha256":
                        cols[o] = [hashlib.sha256(",".join([u[1] for u in x]).encode()).hexdigest() for x in found]
                    else:
                        cols[o] = [hashlib.sha256(d.encode()).hexdigest() for d in decoded]
                yield pa.RecordBatch.from_pydict(cols)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, " + ", ".join(f"{o} {types[o]}" for o in outputs))


def digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    return tokenize(docs, model, ["n_tokens", "ids_sha256", "decoded_sha256"])


def query(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
