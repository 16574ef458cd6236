"""The secret scan against a plain search of every text and all pairs of its parts."""

import hashlib
import random
import re
import sys
from collections import Counter

from waveloom.llm import secrets

FORMS = [
    re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+"),
    re.compile(r"""(access_?key_?id|client_?id|app_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9](?-i:[A-Za-z0-9@._-]{2,})""".replace("(?-i:", "(?:"), re.I | re.A),
    re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\x00-\x20"'<>]+"""),
]
LEAST = [lambda m: len(m[2]) >= 8, lambda m: len(m[0]) >= 16, lambda m: len(m[0]) >= 32, lambda m: True,
         lambda m: all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]")), lambda m: True]
CLASS, ROLE = [0, 0, 0, 2, 3, 1], ["secret", "id", "secret", "id", "secret", "end"]
NEEDS = {3: lambda r: "secret" in r, 4: lambda r: "id" in r or "end" in r, 5: lambda r: {"id", "secret"} <= r}


def scan(text, reach):
    text = text or ""
    breaks = [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    parts = [(m.start(), k, m.end()) for k, f in enumerate(FORMS) for m in f.finditer(text) if LEAST[k](m)]
    base = [p for p in parts if p[1] < 3]
    left = [p for p in parts if not any(CLASS[o[1]] < CLASS[p[1]] and o[0] < p[2] and o[2] > p[0] for o in parts)]
    scope = {p: sum(b <= p[0] for b in breaks) for p in left}
    found = []
    for p in left:
        if p[1] >= 3:
            roles = {ROLE[o[1]] for o in left if scope[o] == scope[p] and abs(o[0] - p[0]) <= reach}
            if NEEDS[p[1]](roles):
                found.append(p)
    say = lambda ps: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(ps))
    n = Counter(p[1] for p in base)
    return n[0], n[1], n[2], hashlib.sha256(say(base).encode()).hexdigest(), say(base + found), len(found)


def make(seed, n):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCxyz019+/") for _ in range(k))
    kinds = [lambda: f'token = "{hexes(40)}"', lambda: "password: abc", lambda: "Passwd='longer-value.1='", lambda: "password=token: abcdefgh1", lambda: "API_KEY:x" + hexes(9),
             lambda: "AKIA" + "".join(rng.choice("ABCZ059") for _ in range(rng.randrange(8, 20))), lambda: hexes(rng.randrange(28, 36)), lambda: "user = bob.smith", lambda: "Login:'eve'",
             lambda: mixed(rng.randrange(16, 44)) + "=", lambda: "https://db.example.org:5432/x", lambda: "postgres://u:p@h/" + mixed(24), lambda: "\n\n", lambda: "\n \t\n", lambda: "\n",
             lambda: "wörter und çà", lambda: "🙂 kein", lambda: "word " * rng.randrange(1, 12), lambda: "ſecret=aaaaaaaaaa", lambda: "toKen=aaaaaaaaaa", lambda: "user=AKIA" + "Z" * 16]
    return "".join(rng.choice(kinds)() + rng.choice([" ", "", ", ", "\n"]) for _ in range(n))


def as_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked").collect())


def test_spans_and_links_equal_brute_force(spark):
    rows = [(k, make(k, 1 + k % 40)) for k in range(160)] + [(900, None), (901, ""), (None, make(7, 30)), (None, make(8, 30)), (7, make(7, 8)), (7, make(7, 8))]
    rows.append((950, make(950, 3000)))
    docs = spark.createDataFrame([(i, t, "u", 1, "k") for i, t in rows], "doc_id long, text string, uid string, kind int, spans string").repartition(3)
    for reach in (60, 400):
        want = Counter((i, *scan(t, reach)) for i, t in rows)
        assert as_rows(secrets.find_secrets(docs, reach)) == want
        assert sum(k[6] for k in want) > 100


def test_weak_candidates_need_their_complement(spark):
    key = "Ab1" * 10
    texts = [f"key {key}", f"user: alice, key {key}", f"user: alice {'x ' * 300} {key}", f"user: alice\n\n{key}", f"http://h.example/ and {key}", "http://h.example/ and user: alice",
             f"AKIA{'Z' * 16} {key} http://h.example/"]
    got = dict(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_linked").collect())
    assert got == {0: 0, 1: 2, 2: 0, 3: 0, 4: 1, 5: 0, 6: 2}


def test_odd_tables(spark, docs, corpus, nothing):
    assert secrets.find_secrets(nothing).count() == 0
    assert as_rows(secrets.find_secrets(docs)) == Counter((i, *scan(t, 400)) for i, t in corpus)


def test_many_parts_in_one_text(spark):
    n = 20_000
    text = " ".join(f"user=a{k:05d} {'Aa1' * 7}" for k in range(n))
    r = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["n_linked"] == 2 * n and sys.getsizeof(r["spans"]) > n


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    rows = [(k, make(k, 1 + k % 50)) for k in range(120)] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = secrets.query(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == Counter(con.execute(secrets.oracle()).fetch_df()[got.columns].itertuples(index=False, name=None))
