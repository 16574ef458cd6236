"""Token alignment against a plain comparison of all token ranges."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from waveloom.llm import alignment


def _shown():
    table, spare = {}, 256
    for k in range(256):
        if chr(k).isprintable() and k not in (32, 160, 173) and (33 <= k <= 126 or k >= 161):
            table[chr(k)] = k
        else:
            table[chr(spare)] = k
            spare += 1
    return table


@pytest.fixture(scope="module")
def files():
    return tuple(open(public_tokenizers.path(n), "rb").read() for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def tokens(files, text, tools=[]):
    if not tools:
        a = Tokenizer.from_str(files[0].decode())
        a.encode_special_tokens = True
        tools += [a, sentencepiece.SentencePieceProcessor(model_proto=files[1]), _shown()]
    a, b, shown = tools
    if not text:
        return [], []
    x = [(i, bytes(shown[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    want = (" " + text).encode()
    if b"".join(v for _, v in x) != want or b"".join(v for _, v in y) != want:
        return [], []
    return x, y


def ranges(toks):
    at, out = 0, []
    for i, v in toks:
        out.append((i, at, at + len(v)))
        at += len(v)
    return out


def brute(files, rows):
    found, links = [], []
    for i, t in rows:
        a, b = (ranges(x) for x in tokens(files, t))
        both = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else None
        if both is None:  # long texts: the same pairs by a walk over both lists
            both, p, q = [], 0, 0
            while p < len(a) and q < len(b):
                both.append((a[p][0], b[q][0]))
                e, f = a[p][2], b[q][2]
                p, q = p + (e <= f), q + (f <= e)
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        say, p, q = [], 0, 0
        for e in ends:
            g, h = [], []
            while p < len(a) and a[p][2] <= e:
                g.append(str(a[p][0]))
                p += 1
            while q < len(b) and b[q][2] <= e:
                h.append(str(b[q][0]))
                q += 1
            say.append(",".join(g) + "|" + ",".join(h))
        found.append((i, len(a), len(b), len(ends), hashlib.sha256(";".join(say).encode()).hexdigest() if a else ""))
        links.append(both)
    count = Counter(x for both in links for x in both)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return Counter((i, n_a, n_b, n_g, len(both), sum(count[x] == most[x[1]] for x in both), sum(count[x] for x in both), d)
                   for (i, n_a, n_b, n_g, d), both in zip(found, links, strict=True))


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["▁ piece mark", "a▁b", "  two  blanks ", "\n\n\ttabs\r\n", "日本語のテキスト と 漢字", "🙂🙃 x🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve Ünïcödé ﬁ", " nbsp ls\u0085nel", "x" * 700, "é combining",
       "12345 67,890.12", "ﷺ \u0000 nul", "don't WE'LL I'd", "a", " ", "﻿bom", "​‍", "²½ªº", "ǅ Ⅷ ೫"]


@pytest.mark.parametrize("size", [8 << 20, 4000])
def test_alignment_equals_brute_force(spark, files, size):
    rng = random.Random(3)
    words = "the of and naïve über tokenization 12 kg ... http://x.org/a_b 日本 end".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD)]
    rows += [(200, None), (201, ""), (7, rows[7][1]), (None, "a null id"), (None, None), (300, " ".join(rng.choice(words) for _ in range(4000)))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pair int, ids string").repartition(3)
    got = Counter(tuple(r) for r in alignment.align(df, files, chunk_bytes=size).select(*COLUMNS).collect())
    assert got == brute(files, rows)


def test_odd_tables(spark, files, docs, corpus, nothing):
    assert alignment.align(nothing, files).count() == 0
    assert Counter(tuple(r) for r in alignment.align(docs, files).select(*COLUMNS).collect()) == brute(files, corpus)


def test_ranked_ids_equal_the_library(files):
    pair = alignment.Pair(*files)
    assert pair.ranked is not None
    texts = [t for t in ODD if alignment._SETTLED.match(t)] + ["".join(map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]))]
    assert len(texts) > 8
    for t in texts:
        assert pair.encode([t])[0][0] == pair.a.encode(" " + t, add_special_tokens=False).ids


def test_chunks_in_small_row_groups(spark, docs, files, monkeypatch):
    """A task holds few chunks at a time, however many it writes to a file or reads from it."""
    from pyarrow import parquet as pq
    from waveloom.llm import common

    paths, land = [], common.Scratch.land
    monkeypatch.setattr(alignment, "_GROUP", 1 << 10)
    monkeypatch.setattr(common.Scratch, "land", lambda self, *a: paths.append(land(self, *a)) or paths[-1])
    some = docs.coalesce(1)
    got = {(r["doc_id"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in alignment.align(some, files, 4 << 10).collect()}
    chunks = [pq.ParquetFile(f.removeprefix("file:")) for f in paths[0][0].inputFiles()]
    sizes = [m.row_group(k).num_rows for m in (f.metadata for f in chunks) for k in range(m.num_row_groups)]
    assert sum(sizes) > 10 and max(sizes) <= 2
    assert got == {(r["doc_id"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in alignment.align(some, files).collect()}
