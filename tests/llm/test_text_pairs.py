"""Operators that compare texts with each other: leaks, near duplicates, repeated passages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.llm import common, jaccard, substring, templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# ---- repeated passages --------------------------------------------------------------------------

def repeats(corpus, window=13):
    first = {}
    for i, t in corpus:
        w = words(t)
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k: k + window])
            first[g] = min(first.get(g, i), i)
    for i, t in corpus:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k: k + window])] < i:
                gone[k: k + window] = [True] * window
        yield i, t, w, gone


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 3000, "bucket_windows": 500}])
def test_substring_dedup(docs, corpus, sizes):
    got = Counter((r["doc_id"], r["text"], r["_n_words"], r["_n_removed"]) for r in substring.remove_repeats(docs, **sizes).collect())
    want = Counter((i, None if t is None else " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)) for i, t, w, gone in repeats(corpus))
    assert got == want and sum(k[3] * n for k, n in got.items()) > 500


def test_substring_dedup_keeps_untouched_texts_and_columns(docs, corpus, nothing):
    out = substring.remove_repeats(docs, tidy=False)
    assert out.columns[:1] == ["doc_id"] and set(docs.columns) < set(out.columns)
    got = Counter(r["text"] for r in out.filter("_n_removed = 0").collect())
    assert got == Counter(t for i, t, w, gone in repeats(corpus) if not any(gone))
    assert substring.remove_repeats(nothing).count() == 0


def test_word_hashes_and_windows_follow_words():
    texts = ["a b a b a", "", " x y\x0bz", "ab", "a b"]
    data = [t.encode() for t in texts]
    blob = np.frombuffer(b"".join(data), np.uint8)
    w = common.Words(blob, np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    found = [blob[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert found == [x for t in texts for x in words(t)] and w.count.tolist() == [len(words(t)) for t in texts]
    by = defaultdict(set)
    for x, h in zip(found, w.hash.tolist()):
        by[x].add(h)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    h, at = w.windows(2)
    assert len(h) == 4 + 2 + 1 and len(set(h.tolist())) == 4


# ---- near duplicates ----------------------------------------------------------------------------

def classes(corpus, size=5, threshold=0.8):
    sets = {}
    for i, t in corpus:
        w = words(t)
        if i is not None and w:
            sets[i] = frozenset(tuple(w[k: k + size]) for k in range(max(1, len(w) - size + 1)))
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    label = {i: i for i in reps.values()}
    links = Counter()
    for a in reps:
        for b in reps:
            if reps[a] < reps[b] and len(a & b) >= threshold * len(a | b):
                links[reps[a]] += 1
                links[reps[b]] += 1
                lo, hi = sorted((label[reps[a]], label[reps[b]]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    copies = Counter(sets[i] for i, t in corpus if i in sets)
    for i, _ in corpus:
        yield (i, label[reps[sets[i]]], copies[sets[i]] - 1, links[reps[sets[i]]]) if i in sets else (i, i, 0, 0)


@pytest.mark.parametrize("sizes", [{}, {"bucket": 2, "tile": 2}])
def test_near_duplicates(docs, corpus, sizes):
    got = Counter(tuple(r) for r in jaccard.near_duplicates(docs, recall=0.9999, **sizes).collect())
    want = Counter(classes(corpus))
    assert got == want
    assert sum(1 for k in want if k[3]) == 5 and want[(200, 3, 4, 0)] == 1


def test_near_duplicates_of_nothing(nothing):
    assert jaccard.near_duplicates(nothing).count() == 0


def test_runs_reach_the_recall():
    rng = np.random.default_rng(1)
    runs = jaccard.runs_for(0.95, 1.6, 0.8, 3)
    roots = common.mix(np.arange(1, runs + 1, dtype=np.uint64))
    met = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 100).astype(np.uint64)
        y = np.concatenate([x[:89], rng.integers(0, 2**63, 11).astype(np.uint64)])  # 89 of 111: just over 0.8
        a, b = roots, roots
        for _ in range(3):
            a, b = (np.unique(jaccard._children(t, n, 1.6)[1]) for t, n in ((x, a), (y, b)))
        met += bool(len(np.intersect1d(a, b)))
    assert met / 300 >= 0.91


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (20, 20), (12, 10), (40, 30), (50, 30), (60, 50)]
    scratch = common.Scratch(spark)
    got = {r["node"]: r["comp"] for r in common.components(scratch, spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    assert got == {5: 3, 4: 3, 3: 3, 9: 3, 10: 10, 11: 10, 12: 10, 40: 30, 30: 30, 50: 30, 60: 30}


# ---- leaks --------------------------------------------------------------------------------------

ITEM = "Today Anna has 12 apples and Anna gives 5 kg to Bob while Bob keeps 12 apples for later use"
CASES = {
    "same": (f"Some words first. {ITEM}. And more.", 0),
    "other values": ("Today Carl has 30 apples and Carl gives 7 lb to Dora while Dora keeps 30 apples for later use", 8),
    "inconsistent": ("Today Carl has 30 apples and Emil gives 7 kg to Dora while Dora keeps 31 apples for later use", None),
    "decimal": ("Today Anna has 1,200.5 apples and Anna gives 5 kg to Bob while Bob keeps 1,200.5 apples for later use", 2),
    "half": ("Today Anna has 12 apples and Anna gives nothing at all to anyone who might have asked for them", None),
    "null": (None, None), "empty": ("", None), "long": ("word " * 20_000 + ITEM, 0),
}


def test_leaks(spark, nothing):
    rows = [(k, t, "x", "y") for k, (t, _) in enumerate(CASES.values())]
    docs = spark.createDataFrame([*rows, rows[0], (None, ITEM, "x", "y")], "doc_id long, text string, item_id string, h string")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short"), (9, None), (None, ITEM), (10, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in templates.find_leaks(docs, items).collect()}
    assert got == {(k, 7): n for k, (_, n) in enumerate(CASES.values()) if n is not None}
    same = spark.createDataFrame([(1, "Too short!"), (2, "it is too short"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "2 2 3 4 5 6 7 8 9 10 11 13")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in templates.find_leaks(same, items).collect()} == {(1, 8), (3, 10), (4, 10)}
    assert templates.find_leaks(nothing, items).count() == 0
    assert templates.find_leaks(docs, items.limit(0)).count() == 0


def test_leaks_with_few_slots_that_differ(spark):
    plain = "we count 12 red apples in every one of the large baskets and again 12 red apples in the small ones near the door"
    asked = "Today Anna has 3 apples and Anna gives 5 kg to Bob while Bob keeps 7 pears and 9 plums for later use"
    cases = [plain.replace("again 12", "again 13"), asked.replace("Anna", "Carl").replace("Bob", "Dora").replace(" 3 ", " 4 ").replace(" 5 ", " 4 "),
             "Today Carl has 3 apples and Emil gives 4 kg to Dora while Finn keeps 8 pears and 10 plums for later use"]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    items = spark.createDataFrame([(1, plain), (2, asked)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_changed"] for r in templates.find_leaks(docs, items).collect()}
    assert got == {(0, 1): 1, (1, 2): 6}


def moved_cases():
    """Texts with tokens added, dropped or changed, and items of every length."""
    rng = random.Random(9)
    words = [f"w{k}" for k in "abcdefghijklmnopqrstuvwxyz"] + ["12", "7", "Anna", "kg"]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (40, 40, 24, 9, 8, 7, 5, 3, 2, 1)]
    items += ["we pay " + " ".join(str(rng.randrange(90)) for _ in range(20)), "a 5 b", "x " * 30]
    docs = []
    for t in items:
        w = t.split()
        m = len(w) // 2
        docs += [t, " ".join([*w[:m], "inserted", *w[m:]]), " ".join(w[:m] + w[m + 1:]), "before it " + t + " and after", " ".join([*w[:m], "several", "more", "words", "here", *w[m:]]),
                 " ".join(x if x != "12" else "13" for x in w), " ".join(x.replace("12", "31").replace("7", "9").replace("Anna", "Bob") for x in w), " ".join(w[: max(1, len(w) * 6 // 10)]), t + " " + t]
    docs.append(" ".join(items))
    docs += [None, "", "12", "we pay 1 2 3"]
    return docs, items


def test_moved_and_short_items(spark):
    docs, items = moved_cases()
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in templates.find_leaks(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    for k in range(2):  # whole items of 40 tokens with a token more, a token less, some more, or another value
        assert {(9 * k + j, k) for j in (0, 1, 2, 3, 4, 5, 8)} <= found and (9 * k + 7, k) not in found
    for k in range(len(items)):
        assert (9 * k, k) in found  # word for word, whatever the length
    for k in (5, 6, 7):
        assert (9 * k + 3, k) in found and (9 * k + 1, k) not in found
    assert (9 * 8 + 3, 8) not in found  # two words inside another text are no leak


def test_moved_and_short_items_equal_sql(spark):
    import duckdb
    import pandas as pd

    docs, items = moved_cases()
    documents, benchmark = pd.DataFrame(list(enumerate(docs)), columns=["doc_id", "text"]), pd.DataFrame(list(enumerate(items)), columns=["item_id", "text"])  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = sorted((a, b, round(c, 9), n, m) for a, b, c, n, m in con.execute(templates.oracle()).fetchall())
    got = templates.find_leaks(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], round(r["coverage"], 9), r["n_slots"], r["n_changed"]) for r in got.collect()) == want and len(want) > 60


def test_leak_windows_need_a_power_of_two(docs):
    with pytest.raises(ValueError):
        templates.windows(docs.select(F.split("text", " ").alias("tok")), [], 6)


def test_leak_query_equals_its_sql(spark, table_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{table_dir}/{name}.parquet/*.parquet')")
    want = sorted(con.execute(templates.oracle()).fetchall())
    assert sorted(tuple(r) for r in templates.query(spark, table_dir).collect()) == want and len(want) >= 1


def test_stars_of_a_large_bucket():
    rng = np.random.default_rng(6)
    centres = rng.integers(1, 256, (5, jaccard.SKETCH), dtype=np.uint8)
    who = rng.integers(0, 5, 700)
    sketch = centres[who].copy()
    for row in sketch:
        row[rng.integers(0, jaccard.SKETCH, 5)] = 0  # empty bins
    ids = rng.permutation(10_000)[:700].astype(np.int64)
    x, y = jaccard._stars_by_rows(ids, sketch, 0.6)
    got = dict(zip(x.tolist(), y.tolist()))
    first = [ids[who == c].min() for c in range(5)]
    assert all(got.get(int(i), int(i)) == first[c] for i, c in zip(ids, who))
