"""Classifier, language profiles, vectors, page wrappers and the pipeline."""

import json
import re
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.llm import language, quality, vectors, wrappers

# ---- quality ------------------------------------------------------------------------------------


def labelled(spark, n=240):
    rng = random.Random(8)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(8, 80))]
        bad = k % 3 == 0
        rows.append((k, " ".join(f"{w.upper()}!!" for w in words) if bad and k % 2 else " ".join(w for w in words for _ in range(4)) if bad else " ".join(words) + ".", int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_quality_on_held_out_texts(spark, docs, nothing):
    rows = labelled(spark)
    train = rows.filter("doc_id % 4 <> 2")
    model = quality.fit(train, rows.select("doc_id", "quality"))
    out = quality.score(rows, model).collect()
    held = [r for r in out if r["doc_id"] % 4 == 2]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    odd = quality.score(docs, model).collect()
    assert len(odd) == docs.count() and set(docs.columns) | {"predicted"} == set(odd[0].asDict())
    same = {r["score"] for r in odd if not (r["text"] or "").strip()}
    assert len(same) <= 2 and len({r["score"] for r in odd if r["doc_id"] in (3, 200, 201)}) == 1
    assert quality.score(nothing, model).count() == 0


def test_quality_without_two_classes(spark, docs, nothing):
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    for labels, want in ((ones, 1.0), (ones.withColumn("quality", F.lit(0)), 0.0), (ones.limit(0), 1.0)):
        assert quality.fit(docs, labels) == {"constant": want}
    assert quality.fit(nothing, ones) == {"constant": 1.0}


def test_dual_descent_is_optimal():
    """No dual variable can be moved to a better value: the optimality conditions hold."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(80)]
    scale, y = rng.normal(size=40), np.where(rng.random(80) < 0.5, 1, -1)
    w, bias, gap = quality.dual_descent(rows, scale, y, tol=1e-8, max_epochs=20_000)
    assert 0 <= gap < 1e-5 < quality.dual_descent(rows, scale, y, tol=1e-8, max_epochs=2)[2]
    x = np.zeros((80, 41))
    for k, c in enumerate(rows):
        x[k, c] = scale[c] / np.linalg.norm(scale[c])
        x[k, 40] = 1
    v = np.append(w, bias)
    loss = lambda u: 0.5 * u @ u + np.maximum(0, 1 - y * (x @ u)).sum()
    for _ in range(200):
        assert loss(v) <= loss(v + rng.normal(size=41) * 10 ** rng.uniform(-6, 0)) + 1e-6


def marks(text):
    """Every indicator of a text by name: byte trigrams, words, make-up of 1 to 3 words together."""
    data = text.encode()
    words = [w for w in re.split(rb"[\t-\r ]+", data) if w]
    kinds = [lambda c: chr(c).islower() and c < 128 or c >= 128, lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: chr(c) in "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"]
    make = [(*(any(map(k, w)) for k in kinds), n > 0 and words[n - 1] == w) for n, w in enumerate(words)]
    return {("t", data[k: k + 3]) for k in range(len(data) - 2)} | {("w", w) for w in words} | {("m", *make[k: k + n]) for n in (1, 2, 3) for k in range(len(make) - n + 1)}


def test_indicators_and_ratios_equal_plain_counts(spark):
    texts = ["The cat, the CAT 12", "the the dog* x", "", "é 12", "a", "ab", "The cat, the CAT 12 again", "dog dog dog #1"]
    data = [t.encode() for t in texts]
    doc, col = quality.indicators(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    cols = [set(col[doc == k].tolist()) for k in range(len(texts))]
    for a in range(len(texts)):
        for b in range(a + 1):
            assert len(cols[a] & cols[b]) == len(marks(texts[a]) & marks(texts[b]))
    y = [1, 0, 1, 0, 1, 0, 1, 0] * 3
    rows = list(enumerate(texts * 3))
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int"))
    sums = np.ones((2, 1 << quality.BITS))
    for (k, t), v in zip(rows, y):
        sums[v][list(cols[texts.index(t)])] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    assert np.allclose(model["square"], ratio**2, rtol=1e-5, atol=1e-12) and model["gap"] < 0.05


def test_a_label_with_many_rows_counts_one_text(spark):
    rows = [(7, f"bad text {k}") for k in range(500)] + [(k, "good words here" if k % 2 else "junk *** 99") for k in range(100, 160)]
    labels = [(7, 0)] + [(k, k % 2) for k in range(100, 160)]
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert "weight" in model and 0 <= model["gap"] < 0.05


# ---- language -----------------------------------------------------------------------------------

def test_profiles_and_distance_against_counts(spark, nothing):
    texts = [("en", "the cat and the hat"), ("en", "The THE the!"), ("fr", "le chat et le chapeau"), ("fr", None), (None, "zzz"), ("de", "der hut und die katze")]
    df = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    from collections import Counter

    def grams(t):
        c = " " + " ".join("".join(ch if ch.isalpha() else " " for ch in t.lower()).split()) + " "
        return [c[i: i + n] for n in (1, 2, 3) for i in range(len(c) - n + 1) if c[i: i + n] != " " and " " not in c[i + 1: i + n - 1]]

    def pack(g):
        v = 0
        for ch in g:
            v = v << 21 | ord(ch)
        return v

    def top(counter, size):
        return [pack(g) for g, _ in sorted(counter.items(), key=lambda x: (-x[1], pack(x[0])))[:size]]

    want = {}
    for x in ("en", "fr", "de"):
        want[x] = top(Counter(g for y, t in texts if y == x and t for g in grams(t)), 20)
    rows = [tuple(r) for r in language.profiles(df, 20).collect()]
    assert {x: [g for _, g, _ in sorted((r for r in rows if r[0] == x), key=lambda r: r[2])] for x in want} == want
    got = {r["doc_id"]: r for r in language.predict(df, rows, 20).collect()}
    for k, (_, t) in enumerate(texts):
        if t:
            own = top(Counter(grams(t)), 20)
            d = {x: sum(abs(want[x].index(g) - i) if g in want[x] else 20 for i, g in enumerate(own)) for x in sorted(want)}
            assert got[k]["lang_pred"] == min(d, key=lambda x: (d[x], x))
    assert got[3]["lang_pred"] == "und" and got[3]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.profiles(nothing).count() == 0 and language.predict(nothing, rows).count() == 0
    assert {r["lang_pred"] for r in language.predict(df, []).collect()} == {"und"}


def test_language_of_odd_texts(docs):
    rows = [("en", int(g), k) for k, g in enumerate(language.ranked(language.grams("the of and alpha"), 300))]
    out = language.predict(docs, rows).collect()
    assert len(out) == docs.count() and {r["lang_pred"] for r in out if r["doc_id"] in (400, 401, 402)} == {"und"}


def test_language_query_on_held_out_rows(spark, sf_dir):
    want = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = language.query(spark, sf_dir).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) >= 0.95


# ---- vectors ------------------------------------------------------------------------------------

def test_nearest_neighbours_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[1000:1400] = x[1000]  # a vector that many rows repeat
    df = spark.createDataFrame([(k, [float(v) for v in r], "c", 1.0) for k, r in enumerate(x)], "vec_id long, embedding array<float>, list string, score double")
    x = np.array([r["embedding"] for r in df.orderBy("vec_id").collect()], float)
    got: dict = {}
    for r in vectors.nearest_neighbours(df, df.filter("vec_id % 100 = 0"), k=10, sample=800, group=400, chunk=16, column_block=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and all(r[2] == pytest.approx(x[q] @ x[r[1]], abs=1e-12) for r in rows)
        assert [(-r[2], r[1]) for r in rows] == sorted((-r[2], r[1]) for r in rows)
        hit += len({r[1] for r in rows} & set(best.tolist()))
    assert hit / 300 >= 0.9


def test_nearest_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r)[:3] for r in vectors.nearest_neighbours(df, df, probe=1.0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 0), (2, 2, 1)]
    assert vectors.nearest_neighbours(df.limit(0), df).count() == 0
    assert vectors.nearest_neighbours(df, df.limit(0)).count() == 0


def test_scan_abandons_early_and_keeps_the_best():
    """Directions without any structure: the share of pairs alive falls from block to block, neighbours stay."""
    rng = np.random.default_rng(3)
    x, q = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(8000, 64)), rng.normal(size=(40, 64))))
    turn = vectors.Index(x, 8).rotation
    ends = vectors.ends_of(64, 16)
    s = q @ x.T
    floor = np.sort(s, 1)[:, -20]
    alive: list = []
    a, b = vectors.scan_list(vectors.Columns(q @ turn, ends), floor - 1e-9, vectors.Columns(x @ turn, ends), ends, 2.0, alive)
    share = np.array(alive[0][:-1]) / alive[0][-1]
    assert share[0] < 0.65 and share[1] < 0.3 and share[2] < 0.1 and share[3] <= 20 / 8000 + 1e-9
    kept = set(zip(a.tolist(), b.tolist()))
    assert np.mean([(i, j) in kept for i in range(40) for j in np.argsort(-s[i])[:20]]) >= 0.94
    # with structure in few directions nearly all are gone after the first block
    spread = np.concatenate([np.full(8, 4.0), np.full(56, 0.3)])
    y = rng.normal(size=(4000, 64)) * spread @ np.linalg.qr(rng.normal(size=(64, 64)))[0]
    floor = np.sort(y[:20] @ y.T, 1)[:, -20]
    turn, alive = vectors.Index(y, 8).rotation, []
    vectors.scan_list(vectors.Columns(y[:20] @ turn, ends), floor - 1e-9, vectors.Columns(y @ turn, ends), ends, 2.0, alive)
    assert alive[0][0] < 0.03 * alive[0][-1]


@pytest.mark.parametrize("n", [20, 21, 37, 40, 45, 60])
def test_small_tables_give_full_results(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8))
    x[n // 2:] = x[0] + rng.normal(size=(n - n // 2, 8)) * 1e-3
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in vectors.nearest_neighbours(df, df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = 0
    for q in range(n):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(n), -s))[: min(20, n - 1)]
        assert [r for r, _ in sorted(got[q])] == list(range(1, min(20, n - 1) + 1))
        hit += len({v for _, v in got[q]} & set(best.tolist()))
    assert hit >= 0.9 * n * min(20, n - 1)


def test_many_copies_of_a_vector_keep_the_smallest_ids(spark):
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(300)] + [(1000 + k, [0.01 * k, 1.0, 0.0]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got: dict = {}
    for r in vectors.nearest_neighbours(df, df.filter("vec_id in (0, 7, 299)"), k=5, group=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: [v for _, v in sorted(r)] for q, r in got.items()} == {0: [1, 2, 3, 4, 5], 7: [0, 1, 2, 3, 4], 299: [0, 1, 2, 3, 4]}


# ---- pages --------------------------------------------------------------------------------------

def page(body, menu=3, extra=""):
    items = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(menu))
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body class=x><nav><ul>{items}</ul></nav><!-- c -->{extra}{body}<footer>&copy; me</footer></body></html>"


def test_article_parts_and_references():
    html = page("<article><h1>A &amp; B</h1><p>one <b>two\n\n three</b><p>four&nbsp;five<div class='share-box'>Share</div><ul><li>x<li>y</ul><section id=comments><p>Nice!</p></section><form>go</form></article>", extra="<div class=ad>Buy</div>")
    assert wrappers.main_text(html, ["html", "body.x", "article"]) == "A & B\none two three\nfour five\nx\ny"
    assert wrappers.main_text(html, None) == wrappers.main_text(html, ["html", "none"]) == "A & B\none two three\nfour five\nx\ny"


def test_deep_pages():
    """Elements nested to any depth: all text stays, in order; parts that are off stay off."""
    for n in (150, 800, 10_000):
        t = wrappers.main_text("<html><body><main>" + "<div>a<b>b</b>" * n + "mid" + "</div>t" * n + "<p>end</p></main></body></html>", None)
        assert t.split("\n") == ["ab"] * (n - 1) + ["abmid"] + ["t"] * n + ["end"]
    t = wrappers.main_text("<body><main><p>x</p>" + "<span>" * 5000 + "deep" + "</span>" * 5000 + "<nav>" + "<div>" * 1000 + "menu" + "</div>" * 1000 + "</nav><p>end</p></main>", None)
    assert t == "x\ndeep\nend"
    t = wrappers.main_text("<body><main>" + "<div>" * 300 + "<nav><div>menu</div> more</nav><p>one <b>two</b> three</p><math><mi>x</mi></math>" + "</div>" * 300, None)
    assert t == "one two three\nx"


def test_wrappers_do_not_depend_on_the_order_of_pages(spark):
    import random

    rng = random.Random(6)
    parts = ["<h2>{}</h2>", "<p>{}</p>", "<div class=x><p>{}</p></div>", "<ul><li>{}</li><li>b</li></ul>", "<div class=y>{}</div>", "<table><tr><td>{}</td></tr></table>"]
    pages = [(k, f"http://h{k % 3}/", "<body><div>" + "".join(rng.choice(parts).format(f"t{rng.randrange(30)}") for _ in range(rng.randrange(1, 6))) + "</div></body>") for k in range(60)]
    pages.append((99, "http://h1/", "<body>" + "<div>" * 10_000 + "deep" + "</div>" * 10_000))
    found = []
    for n in (1, 2, 3, 5, 7):
        rng.shuffle(pages)
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(n)
        rules = wrappers.infer(df, run=4, fan=3).collect()
        assert len(rules) == 3
        found.append((sorted(tuple(r) for r in rules), sorted(tuple(r) for r in wrappers.extract(df).select("page_id", "text").collect())))
    assert all(f == found[0] for f in found[1:])


def test_wrapper_of_aligned_pages():
    pages = [page("<div class=main><h2>t1</h2><p>aaaa aaaa</p></div>", 2), page("<div class=main><h2>t2</h2><p>bbbb</p><p>cccc</p><h2>t3</h2><p>d</p></div>", 4, "<div class=notice>n</div>")]
    w = wrappers._merge(*[wrappers.wrapper(wrappers.parse(p)) for p in pages])
    text = wrappers.expression(w)
    assert "(<li> <a> #PCDATA </> </>)+" in text and "(<div.notice> #text </>)?" in text and "(<h2> #PCDATA </> (<p> #PCDATA </>)+)+" in text
    assert wrappers.content_path(w) == ["html", "body.x", "div.main"]
    assert json.loads(json.dumps(w)) == w


def test_pages_of_a_host_share_its_wrapper(spark):
    rows = [(k, f"https://Site.example/{k}", page(f"<div class=main><p>text number {k} {'long ' * k}</p></div><div class=box><p>constant box that never changes at all, not once on any page of the site</p></div>")) for k in range(12)]
    rows += [(50, None, None), (51, "odd", ""), (52, "https://site.example", "no markup at all &lt;"), (53, "x://y", "<p>cut <b>off"), (None, "https://site.example/q", rows[1][2]), rows[2],
             (54, "https://long.example", page("<article><p>" + "w " * 60_000 + "</p></article>"))]
    df = spark.createDataFrame([(*r, "z", "h") for r in rows], "page_id long, url string, html string, text string, host string").repartition(5)
    got: dict = {}
    for r in wrappers.extract(df).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    for k in range(12):
        assert set(got[k]) == {f"text number {k} {'long ' * k}".strip()}
    assert len(got[2]) == 2 and got[50] == [""] and got[51] == [""] and got[52] == ["no markup at all <"] and got[53] == ["cut off"] and len(got[54][0]) == 119_999
    assert got[None] == got[1]
    assert wrappers.extract(df.limit(0)).count() == 0


def test_article_parts_beside_each_other_are_kept(spark):
    words = lambda k, n, x: " ".join(f"{x}{k}{j}" for j in range(n))
    hosts = {
        "a": "<div class=wrap><div class=lead><p>{0}</p></div><div class=body><p>{1}</p></div><div class=fix>same</div></div>",
        "b": "<div><section class=a>{0}</section><section class=b>{1}</section></div><nav>{0}</nav>",
        "c": "<article class=lead>{0}</article><div class=fix>same</div><article class=body><p>{1}</p></article>",
        "d": "<main><h1>{0}</h1><article><p>{1}</p></article></main>",
    }
    rows = [(f"{h}{k}", f"http://{h}.x/{k}", page(t.format(words(k, 8, "u"), words(k, 12, "v")))) for h, t in hosts.items() for k in range(4)]
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    whole = lambda h, k: f"{words(k, 8, 'u')}\n{words(k, 12, 'v')}" + ("\nsame" if h == "a" else "")
    assert got == {f"{h}{k}": whole(h, k) for h in hosts for k in range(4)}


def test_names_that_only_contain_a_word_stay_on(spark):
    off = ["sidebar", "left-sidebar", "sidebar_2", "share-box", "ads-container", "site-header", "comments"]
    on = ["has-sidebar", "content-with-sidebar", "with-sidebar", "no-ads", "article-header", "post-share", "social-science", "never-shared", "content"]
    assert [n for n in off + on if wrappers._named_off(n)] == off
    hosts = {"a": "<div class='content with-sidebar'><p>{0}</p><div class=sidebar>{1}</div></div>", "b": "<div class=popup><p>{0}</p><div class=ad>{1}</div></div>",
             "c": "<div id=main><p>{0}</p></div><div class=ads>{1}</div>"}
    rows = [(f"{h}{k}", f"http://{h}.x/{k}", page(t.format(f"long text {k} " * 9, f"ad {k}")).replace("<body class=x>", "<body class='has-sidebar no-ads sidebar'>")) for h, t in hosts.items() for k in range(3)]
    rows.append(("d", "http://d.x", "<body class=sidebar><div class=widget>alone on its host</div>"))
    got = {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {f"{h}{k}": (f"long text {k} " * 9).strip() for h in hosts for k in range(3)} | {"d": "alone on its host"}


# ---- pipeline -----------------------------------------------------------------------------------

def test_pipeline_stages(spark, table_dir, docs):
    import corpus_pipeline as cp
    from test_text_pairs import classes, repeats

    plain = spark.read.parquet(f"{table_dir}/documents.parquet")
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    kept = cp.good_quality(spark, plain, table_dir)
    assert kept.columns == plain.columns and kept.count() <= plain.count()
    once = cp.distinct_documents(spark, plain, table_dir)
    ids = sorted(i for i, _ in rows(once) if i is not None)
    assert ids == sorted({c[1] for c in classes(rows(plain)) if c[0] is not None}) and once.filter("doc_id is null").count() == plain.filter("doc_id is null").count()
    cut = cp.without_repeats(spark, plain, table_dir)
    want = sorted((i or -1, t if not any(g) else " ".join(x for x, y in zip(w, g) if not y)) for i, t, w, g in repeats(rows(plain)) if t is not None)
    assert sorted((i or -1, t) for i, t in rows(cut) if t is not None) == want and cut.columns == plain.columns
    clean = cp.without_leaks(spark, plain, table_dir)
    gone = {i for i, _ in rows(plain)} - {i for i, _ in rows(clean)}
    assert 5 in gone and len(gone) == 1
    assert cp.run(spark, table_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_on_an_empty_table(spark, table_dir, tmp_path):
    import corpus_pipeline as cp

    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{table_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
