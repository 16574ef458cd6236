"""Secret scan with multipart credential linking, with DataFrame functions only.

Strong forms (assignments, access ids, long hex) are always reported. Weak forms (names of accounts, mixed
strings, endpoints) are candidates, reported only where parts that complement each other lie close together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table


def _either_case(words: str) -> str:
    """The pattern with its ASCII letters in either case, also where an engine folds other letters to them."""
    return "".join(f"[{x.upper()}{x}]" if "a" <= x <= "z" else x for x in words)


GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
#: fixed values: forms of the base scan
ASSIGN = f"(?:{_either_case('password|passwd|secret|token|api_?key')}){GIVEN}"
ASSIGN_VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
#: forms of weak candidates
NAMED = f"(?:{_either_case('access_?key_?id|client_?id|app_?id|user_?name|user|login|account')}){GIVEN}" + "[A-Za-z0-9][A-Za-z0-9@._-]{2,}"
MIXED = "[A-Za-z0-9+/]{20,}={0,2}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]{1,30}://[^\x00-\x20"'<>]+"""
BREAK = r"\n[\x20\t\r]*\n"

#: kinds in their order of listing; a part is dropped where it overlaps a part of an earlier class of CLASSES
KINDS = ("assign", "access", "hex", "identifier", "mixed", "endpoint")
_PATTERNS = (ASSIGN + ASSIGN_VALUE, ACCESS, HEX, NAMED, MIXED, ENDPOINT)
_SCOPE = len(KINDS)
CLASSES = (0, 0, 0, 2, 3, 1)  # base, endpoint, identifier, mixed
ROLES = ("secret", "id", "secret", "id", "secret", "host")


def _kept(kind: int, x: Column) -> Column:
    if kind == 0:
        return F.length(F.regexp_extract(x, f"{ASSIGN}({ASSIGN_VALUE})", 1)) >= 8
    if kind == 4:
        return x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]")
    return F.lit(True)


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """array of (kind, i, gap, size, kept): each match, its size and the gap before it, in code points."""
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("size"), _kept(kind, x).alias("kept")))
    rows = F.transform(pairs, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), p["gap"].alias("gap"), p["size"].alias("size"), p["kept"].alias("kept")))
    return F.when(text.rlike(pattern), F.filter(rows, lambda r: r["size"].isNotNull()))


def _parts(matches: DataFrame) -> DataFrame:
    """uid, kind, start, end: positions of the matches that count, from running sums over one text's matches of a kind."""
    run = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    m = matches.select("uid", F.explode("m").alias("p")).select("uid", "p.*")
    m = m.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(run))
    return m.filter("kept").select("uid", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def link(parts: DataFrame, reach: int = 400) -> DataFrame:
    """uid, kind, start, end of the weak candidates whose complementary parts co-occur.

    ``parts`` has all parts and the breaks between scopes. A candidate that overlaps a part of an earlier class is
    dropped (base, endpoint, identifier, mixed string). Of those left, an identifier needs a secret, a mixed
    string needs an identifier or an endpoint, an endpoint needs an identifier and a secret, in the same scope and
    with starts at most ``reach`` apart.

    The interval join is by cells of ``reach`` code points: each cell keeps the first and the last start of each
    role, each candidate meets its own cell and the two beside it, so no pairs of parts are made however many
    parts one text has.
    """
    kind = F.col("kind")
    rank = F.element_at(F.array(*[F.lit(k) for k in (*CLASSES, 9)]), kind + 1)
    role = F.element_at(F.array(*[F.lit(k) for k in (*ROLES, "break")]), kind + 1)
    ahead = Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("uid").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    p = parts.withColumn("rank", rank).withColumn("role", role)
    p = p.withColumn("scope", F.count(F.when(kind == _SCOPE, 1)).over(ahead))
    last = [F.max(F.when(F.col("rank") < k, F.col("end"))).over(ahead).alias(f"before{k}") for k in (1, 2, 3)]
    first = [F.min(F.when(F.col("rank") < k, F.col("start"))).over(behind).alias(f"after{k}") for k in (1, 2, 3)]
    p = p.select("*", *last).select("*", *first)
    clear = F.lit(True)
    for k in (1, 2, 3):
        apart = (F.coalesce(F.col(f"before{k}") <= F.col("start"), F.lit(True)) & F.coalesce(F.col(f"after{k}") >= F.col("end"), F.lit(True)))
        clear = clear & ((F.col("rank") != k) | apart)
    p = p.filter((kind < _SCOPE) & clear).select("uid", "scope", F.floor(F.col("start") / reach).alias("cell"), "kind", "role", "start", "end")

    of = lambda r: F.when(F.col("role") == r, F.col("start"))
    cells = p.groupBy("uid", "scope", "cell").agg(*[f(of(r)).alias(f"{n}_{r}") for r in ("id", "secret", "host") for n, f in (("low", F.min), ("high", F.max))])
    asks = p.filter(kind >= 3).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("cell", F.col("cell") + F.col("side"))
    met = asks.join(cells, ["uid", "scope", "cell"])
    near = {r: F.max(F.coalesce((F.col(f"low_{r}") <= F.col("start") + reach) & (F.col(f"high_{r}") >= F.col("start") - reach), F.lit(False))).alias(r)
            for r in ("id", "secret", "host")}
    near = met.groupBy("uid", "kind", "start", "end").agg(*near.values())
    return near.filter(((kind == 3) & F.col("secret")) | ((kind == 4) & (F.col("id") | F.col("host"))) | ((kind == 5) & F.col("id") & F.col("secret"))).select("uid", "kind", "start", "end")


def find_secrets(docs: DataFrame, reach: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: one row per row of ``docs``.

    spans: ``kind:start:end`` of all spans by start, then kind in the order of ``KINDS``, then end, joined by commas;
    code points, end exclusive. base_sha256: digest of the same list with the first three kinds only.
    n_linked counts the weak candidates reported. A scope ends at a blank line.

    Null and empty texts have no spans (zeros, an empty list and its digest). Rows that repeat an id, or have a
    null one, are rows of their own. Other columns are not read, whatever their names. A text's work is linear in its
    length but for the sorts of its matches; texts are read once, later steps move the places of matches only.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [_matches(text, k, p) for k, p in enumerate(_PATTERNS)]
    d = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[f.alias(f"m{k}") for k, f in enumerate(found)])
    weak = F.coalesce(*[F.col(f"m{k}") for k in range(3, _SCOPE)]).isNotNull()
    d = d.select("id", *[f"m{k}" for k in range(_SCOPE)], F.when(weak, _matches(F.col("text"), _SCOPE, BREAK)).alias(f"m{_SCOPE}"))
    none = F.lit(None).cast("array<struct<kind:int,i:int,gap:int,size:int,kept:boolean>>")
    both = F.flatten(F.array_compact(F.array(none, *[F.col(f"m{k}") for k in range(_SCOPE + 1)])))
    # the number of a row is drawn once, by being written
    rows, _ = scratch.land(d.select("id", both.alias("m")).select("id", "m", F.when(F.exists("m", lambda r: (r["kind"] < _SCOPE) & r["kept"]), F.uuid()).alias("uid")))
    parts, _ = scratch.land(_parts(rows.filter("uid is not null")))
    spans = parts.filter("kind < 3").unionByName(link(parts, reach))
    per = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    say = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("s", lambda x: x["kind"] < 3)
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    hit = rows.filter("uid is not null").select("id", "uid").join(per, "uid", "left").select("id", F.coalesce("s", empty).alias("s"))
    out = hit.unionByName(rows.filter("uid is null").select("id", empty.alias("s")))
    return out.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(say(base), 256).alias("base_sha256"),
                      say("s").alias("spans"), (F.size("s") - F.size(base)).cast("long").alias("n_linked"))


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def oracle(reach: int = 400) -> str:
    """DuckDB SQL for ``query``: candidates are compared with all parts of their text, pair by pair."""
    def q(p):
        return "'" + p.replace("'", "''") + "'"

    def places(k, pattern):
        return (f"SELECT rid, {k} AS kind, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x, unnest(g[1 : len(x)]) AS g "
                f"FROM (SELECT rid, regexp_extract_all(t, {q(pattern)}, 0) AS x, regexp_split_to_array(t, {q(pattern)}) AS g FROM d) WHERE len(x) > 0")

    every = "\nUNION ALL ".join(places(k, p) for k, p in enumerate((*_PATTERNS, BREAK)))
    rank = "CASE kind " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(CLASSES)) + " END"
    role = "CASE kind " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(ROLES)) + " END"
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
    near = "EXISTS (SELECT 1 FROM alone o WHERE o.rid = w.rid AND o.scope = w.scope AND o.role = '{0}' AND abs(o.s - w.s) <= " + str(reach) + ")"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({every}),
placed AS (SELECT rid, kind, x, sum(length(g) + length(x)) OVER (PARTITION BY rid, kind ORDER BY i) AS e, length(x) AS n FROM m),
p AS MATERIALIZED (SELECT rid, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, {rank} AS c, {role} AS role FROM placed
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(x, {q(f'{ASSIGN}({ASSIGN_VALUE})')}, 1)) >= 8
    WHEN 4 THEN regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') ELSE true END),
alone AS MATERIALIZED (SELECT *, (SELECT count(*) FROM p b WHERE b.rid = p.rid AND b.kind = {_SCOPE} AND b.e <= p.s) AS scope FROM p
  WHERE kind < {_SCOPE} AND NOT EXISTS (SELECT 1 FROM p o WHERE o.rid = p.rid AND o.c < p.c AND o.s < p.e AND o.e > p.s)),
linked AS (SELECT rid, kind, s, e FROM alone w WHERE (kind = 3 AND {near.format('secret')})
  OR (kind = 4 AND ({near.format('id')} OR {near.format('host')})) OR (kind = 5 AND {near.format('id')} AND {near.format('secret')})),
spans AS (SELECT rid, kind, s, e FROM p WHERE kind < 3 UNION ALL SELECT * FROM linked),
said AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_linked,
  string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < 3) AS base, string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked
FROM d LEFT JOIN said USING (rid)
"""
