"""Token operators against the libraries, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from waveloom.llm import pieces, repair, separators, wordbpe

ODD = ["", " ", "  a  b ", "a <|endoftext|> b", "É's It'S 12ab", "naïve İstanbul ΑΣ", "\x1cx\x85y\xa0z  q", "ﬁ é Å 漢字 😀!?", "a\x00b 'T 've", "ſ K ȺȺ ªº×÷ ²³", "<s> </s> <0x41> <unk>",
       "▁ a▁▁b", "x" * 300, "the" * 200 + "  " * 40 + "z", "\n\n \t"]


def odd_texts():
    rng = random.Random(2)
    return ODD + ["".join(rng.choice("abst19 .!éßÑẞİ漢😀'\n\t|<>▁") for _ in range(rng.randrange(1, 90))) for _ in range(400)]


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.mark.parametrize("literal", [False, True])
def test_word_encoder_equals_the_library(literal):
    coder, texts = wordbpe.load(read("word_bpe_49k.json")), odd_texts()
    flat, sizes = coder.encode_arrow(pa.array(texts), 1, literal)
    coder.whole.encode_special_tokens = literal
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert flat[at: at + n].tolist() == [*coder.whole.encode(t, add_special_tokens=False).ids, 1], t
        at += n


def test_word_encoder_begins_its_table_anew(monkeypatch):
    monkeypatch.setattr(wordbpe, "_BITS", 12)
    small, texts = wordbpe.WordBpe(read("word_bpe_49k.json")), [f"word{k} x{k * 7919}" for k in range(3000)]
    got = [small.encode_arrow(pa.array(texts[k: k + 500]), 1)[0] for k in range(0, 3000, 500)]
    whole = [i for t in texts for i in [*small.whole.encode(t, add_special_tokens=False).ids, 1]]
    assert np.concatenate(got).tolist() == whole


def test_piece_agenda_equals_the_library():
    codec, texts = pieces.load(read("piece_bpe_32k.model")), odd_texts()
    for t, found in zip(texts, codec.encode(texts)):
        assert [i for u in found for i in u[0]] == codec.library.encode(t), t
    long = "".join(random.Random(1).choice("etaoin shr▁dlu") for _ in range(5000)).replace(" ", "")
    assert [i for u in codec.encode([long])[0] for i in u[0]] == codec.library.encode(long)


def test_piece_query(spark, docs, corpus, nothing, table_dir):
    sp = pieces.load(read("piece_bpe_32k.model")).library
    got = sorted(((r["doc_id"] or -1), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.query(spark, table_dir).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i or -1, len(e := sp.encode(t or "")), sha(",".join(map(str, e))), sha(sp.decode(e))) for i, t in corpus)
    assert got == want
    full = pieces.tokenize(docs, read("piece_bpe_32k.model"), ["ids", "decoded"]).collect()
    assert sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in full) == sorted((i or -1, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in corpus)
    assert pieces.digests(nothing).count() == 0


def test_grammar_round_trip():
    rng = random.Random(3)
    for trial in range(150):
        n = rng.randrange(0, 200)
        ids = np.array([rng.randrange(0, 1 + trial % 4) for _ in range(n)], np.uint16)
        sizes = []
        while sum(sizes) < n:
            sizes.append(min(rng.randrange(0, 30), n - sum(sizes)))
        sizes = np.array([0, *sizes, 0], np.int64)
        block = repair.Block(repair.Block.encode(ids, sizes, 5, min_count=2))
        assert (block.ids() == ids).all() and (block.sizes() == sizes).all()
        ends = np.cumsum(sizes)
        k = rng.randrange(len(sizes))
        assert (block.ids(k, k + 1) == ids[ends[k] - sizes[k]: ends[k]]).all()


def test_grammar_replaces_the_frequent_pairs():
    ids = np.array([1, 2, 3] * 400 + [4, 4] * 100, np.uint16)
    block = repair.Block(repair.Block.encode(ids, np.array([len(ids)]), 5, min_count=4))
    assert len(block.symbols) < len(ids) / 20 and (block.lengths >= 2).all()
    with pytest.raises(ValueError):
        repair.Block(b"x" * 64)


def test_token_files(spark, docs, corpus, nothing, tmp_path):
    vocabulary = read("word_bpe_49k.json")
    coder = wordbpe.load(vocabulary)
    coder.whole.encode_special_tokens = False
    for blocks in (1 << 20, 200):
        path = str(tmp_path / f"t{blocks}")
        repair.write_files(docs, path, vocabulary, block_ids=blocks)
        got = repair.read_files(spark, path).collect()
        ids = lambda t: [*coder.whole.encode(t or "", add_special_tokens=False).ids, 1]
        crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
        assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
            (i if i is not None else -1, len(ids(t)), crc(t)) for i, t in corpus)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted(got, key=lambda r: r["start"])]
        assert order == sorted(order)
    repair.write_files(nothing, str(tmp_path / "empty"), vocabulary)
    assert repair.read_files(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan(spark, width):
    rng = random.Random(4)
    files, want = [], []
    for f in range(5):
        ids = [rng.choice([0, 1, 2, 9]) for _ in range(rng.randrange(0, 60))]
        start = place = 0
        for k, x in enumerate(ids):
            if x == 9 or k == len(ids) - 1:
                want.append((f, place, start, k + 1 - start))
                start, place = k + 1, place + 1
        raw = np.array(ids, f"<u{width}").tobytes()
        n = 7 * width
        files += [(f, k, bytearray(raw[n * k: n * k + n]), width) for k in range((len(raw) + n - 1) // n)]
    df = spark.createDataFrame(files, "file int, block long, data binary, width int").repartition(3)
    if width == 2:
        df = df.drop("width")
    assert sorted(tuple(r) for r in separators.count_tokens(df, 9).collect()) == sorted(want)
    assert separators.count_tokens(df.limit(0), 9).count() == 0


def test_document_counts(docs, corpus, nothing):
    vocabulary = read("word_bpe_49k.json")
    coder = wordbpe.load(vocabulary)
    got = separators.document_counts(docs, vocabulary, 49407).collect()
    coder.whole.encode_special_tokens = True
    want = sorted((i if i is not None else -1, len(coder.whole.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in corpus)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in got) == want
    wide = separators.document_counts(docs, vocabulary, 70_000).collect()  # an end id beyond 16 bits: ids of 4 bytes
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in wide) == want
    assert separators.document_counts(nothing, vocabulary, 49407).count() == 0
