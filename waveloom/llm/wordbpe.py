"""Exact encoding with a word-BPE vocabulary file of the tokenizers library, at the cost of its distinct words.

The file lower-cases, splits a text to pieces (letter runs, single digits, symbol runs), and merges
inside each of them, so a text's ids are the joined ids of its pieces. Pieces are looked up in a
bounded cache; the unknown pieces of a batch go to the library's model in one call. Texts of ASCII
without apostrophes and of composed letters are cut and looked up as arrays of 64-bit piece hashes (two
pieces are taken for one with probability 2^-64); other texts of characters below U+0300 are cut by the
file's pattern; a text with any other character goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import U64, HashTable, Words, gather, slices, utf8_bytes

#: Characters below U+0300 are composed already, and lower-case one to one but for U+0130; control
#: characters that Python and the library's pattern do not both take for white space are left out.
_PLAIN = regex.compile(r"[\x00-\x1B\x20-\u012F\u0131-\u02FF]*+\Z")
_HALF = 50_000
_BITS = 21  # slots of the hash table; it is begun anew when half full

#: byte kinds of lower-cased texts: 0 space, 1 letters, 2 symbols, 3 digits (one piece each)
_KIND = np.full(256, 2, np.int8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 3
_LETTERS = [k for k in range(0x80, 0x300) if k != 0x130 and unicodedata.category(chr(k))[0] == "L" and len(chr(k).lower()) == 1
            and ord(chr(k).lower()) < 0x300]
_ARRAYS = r"\A[\x00-\x1B\x20-\x26\x28-\x7F" + "".join(rf"\x{{{k:X}}}" for k in _LETTERS) + r"]*\z"


def _plain_pattern(pattern: str) -> re.Pattern:
    """The file's split pattern for lower-cased plain texts, with the letter and number classes written out."""
    chars = {c for k in range(0x300) for c in (chr(k), chr(k).lower()) if len(c) == 1}
    for name in "LN":  # the file has them inside brackets only
        pattern = pattern.replace(rf"\p{{{name}}}", "".join(sorted(c for c in chars if unicodedata.category(c)[0] == name)))
    return re.compile(pattern)


_LOADED: dict[int, WordBpe] = {}


def load(data: bytes) -> WordBpe:
    """One instance per worker process and vocabulary file."""
    key = zlib.crc32(data)
    if key not in _LOADED:
        _LOADED[key] = WordBpe(data)
    return _LOADED[key]


class WordBpe:
    def __init__(self, data: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(data)
        self.whole = Tokenizer.from_str(data.decode())
        kinds = [p["type"] for p in spec["pre_tokenizer"].get("pretokenizers", [])]
        norms = [p["type"] for p in spec["normalizer"].get("normalizers", [])]
        if norms != ["NFC", "Replace", "Lowercase"] or kinds != ["Split", "ByteLevel"] or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("not a lower-casing word BPE with word ends")
        self.split = _plain_pattern(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_first = regex.compile("|".join(map(regex.escape, self.special)))
        self.inner = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": None}))
        self.inner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.size = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

        self._begin()

    def _begin(self) -> None:
        self.table, self.ids, self.used = HashTable(_BITS), np.zeros(1 << 20, self.dtype), 0
        self.start, self.length = np.zeros(1 << (_BITS - 1), np.int64), np.zeros(1 << (_BITS - 1), np.int64)

    def _from_library(self, new: list[str]) -> list[bytes]:
        """Ids of pieces: one call to the library, cut where an id closes a piece."""
        ids = np.array(self.inner.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(new):  # a piece whose last id does not close it: ask for each
            return [np.array(e.ids, self.dtype).tobytes() for e in self.inner.encode_batch_fast(new, add_special_tokens=False)]
        raw, w = ids.tobytes(), self.dtype.itemsize
        at = (np.concatenate([[0], cuts]) * w).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _entries(self, blob: np.ndarray, w: Words) -> np.ndarray:
        """Cache entry of each piece; pieces met for the first time are encoded and entered."""
        key = np.where(w.hash == 0, U64(1), w.hash)
        entry = self.table.get(key)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            fresh, first = np.unique(key[missing], return_index=True)
            if self.table.size + len(fresh) > len(self.start):
                self._begin()
                return self._entries(blob, w)
            raw = blob.tobytes()
            at = missing[first]
            found = self._from_library([raw[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            n = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
            flat = np.frombuffer(b"".join(found), self.dtype)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used: self.used + len(flat)] = flat
            number = self.table.size + np.arange(len(fresh))
            self.start[number], self.length[number] = self.used + np.cumsum(n) - n, n
            self.used += len(flat)
            self.table.put(fresh, number.astype(np.int32))
            entry = self.table.get(key)
        return entry

    def encode_arrow(self, texts: pa.Array, end_id: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text closed by ``end_id``, and the number of ids of each with it."""
        n = len(texts)
        fast = pc.match_substring_regex(texts, _ARRAYS)
        if not literal:
            for t in self.special:
                fast = pc.and_(fast, pc.invert(pc.match_substring(texts, t)))
        fast = fast.to_numpy(zero_copy_only=False)
        sizes, flats = np.zeros(n, np.int64), []
        blob, offsets = utf8_bytes(pc.utf8_lower(texts.filter(pa.array(fast))))
        at = np.flatnonzero(fast)
        for lo, hi in slices(offsets, 1 << 20):
            part = blob[offsets[lo]: offsets[hi]]
            w = Words(part, offsets[lo: hi + 1] - offsets[lo], _KIND)
            entry = self._entries(part, w)
            length = self.length[entry]
            run = np.concatenate([[0], np.cumsum(length)])[w.first]
            sizes[at[lo: hi]] = np.diff(run)
            flats.append(gather(self.ids, self.start[entry], length))
        slow = np.flatnonzero(~fast)
        if len(slow):
            raw = self.encode(texts.take(pa.array(slow)).to_pylist(), literal)
            sizes[slow] = [len(x) // self.dtype.itemsize for x in raw]
            flats.append(np.frombuffer(b"".join(raw), self.dtype))
        flat = np.concatenate(flats) if flats else np.zeros(0, self.dtype)
        wide = np.dtype("<u2" if max(self.size, end_id + 1) <= 1 << 16 else "<u4")
        if len(slow) and len(at):  # put the two kinds of texts in order again
            own = np.zeros(n, np.int64)
            order = np.concatenate([at, slow])
            own[order] = np.cumsum(sizes[order]) - sizes[order]
            flat = gather(flat, own, sizes)
        ends = np.cumsum(sizes + 1)
        out = np.empty(len(flat) + n, wide)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside], out[ends - 1] = flat, end_id
        return out, sizes + 1

    def _learn(self, new: list[str]) -> None:
        """Put the ids of new pieces in the cache."""
        self.parts.update(zip(new, self._from_library(new), strict=True))

    def encode(self, texts: list[str], literal: bool = False) -> list[bytes]:
        """Ids of each text as little-endian integers of ``self.dtype``.

        As ``Tokenizer.encode(text, add_special_tokens=False)``; with ``literal`` the strings of special
        tokens are ordinary text.
        """
        out: list[bytes | None] = [None] * len(texts)
        whole = [k for k, t in enumerate(texts) if not _PLAIN.match(t) or (not literal and self.special_first.search(t))]
        if whole:
            self.whole.encode_special_tokens = literal
            for k in whole:
                out[k] = np.array(self.whole.encode_batch_fast([texts[k]], add_special_tokens=False)[0].ids, self.dtype).tobytes()
        skip = set(whole)
        findall = self.split.findall
        for lo in range(0, len(texts), 256):
            some = [k for k in range(lo, min(lo + 256, len(texts))) if k not in skip]
            pieces = [findall(texts[k].lower()) for k in some]
            if len(self.parts) > _HALF:
                self.older, self.parts = self.parts, {}
            parts, older = self.parts, self.older
            new = set().union(*pieces).difference(parts)
            if new:
                fresh = new.difference(older)
                parts.update((p, older[p]) for p in new.difference(fresh))
                if fresh:
                    self._learn(list(fresh))
            for k, x in zip(some, pieces, strict=True):
                out[k] = b"".join(map(parts.__getitem__, x))
        return out
