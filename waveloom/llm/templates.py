"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names and units become typed placeholders; windows of the resulting templates are joined by
hash; an alignment is a leak if it covers the item and its placeholders are filled consistently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: words that count as units after a number (fixed list)
UNITS = ("percent", "dollars", "dollar", "euros", "euro", "pounds", "pound", "cents", "cent", "kilograms", "kilogram", "grams", "gram", "kilometers", "kilometer",
         "meters", "meter", "centimeters", "centimeter", "miles", "mile", "inches", "inch", "feet", "foot", "liters", "liter", "gallons", "gallon", "seconds",
         "second", "minutes", "minute", "hours", "hour", "days", "day", "weeks", "week", "months", "month", "years", "year", "kg", "mg", "km", "cm", "mm", "ml",
         "mph", "kwh", "lbs", "lb", "oz", "ft", "g", "m", "l", "s", "h")
# marks before a token: 1 name, 2 number, 3 unit; 4 joins the parts of one number
_NAME, _NUMBER, _UNIT, _JOIN = "\u0001", "\u0002", "\u0003", "\u0004"
_FIRST_WORD = "\u0005"  # anything below it begins with a mark
NAME_AT, SPLIT = r"([\p{Ll}\p{N},;:]) (\p{Lu})", r"[^\p{L}\p{N}\x01-\x04]+"
NUMBER, POINT = r"(\p{N}[\p{N}\x04]*)", r"(\p{N})[.,:](\p{N})"
UNIT_AT = rf"(\x02[^ ]* +)({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)"


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; names, numbers and units carry a mark in front of their value.

    A name is a capitalised word that follows a lower-case letter, a digit, or one of , ; : and one blank; words
    that begin a sentence, a line or a text are not. A number may have points, commas or colons between
    digits. A unit is a word of ``UNITS`` after a number.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), NAME_AT, f"$1 {_NAME}$2")
    point = F.regexp_replace(F.regexp_replace(t, POINT, f"$1{_JOIN}$2"), POINT, f"$1{_JOIN}$2")
    number = F.regexp_replace(point, NUMBER, f" {_NUMBER}$1 ")
    unit = F.regexp_replace(F.lower(number), UNIT_AT, f"$1{_UNIT}$2$3")
    return F.array_remove(F.split(F.when(t.rlike(r"\p{N}"), unit).otherwise(F.lower(t)), SPLIT), "")


def _template(x: Column) -> Column:
    return F.when(x < _FIRST_WORD, F.substring(x, 1, 1)).otherwise(x)


def windows(df: DataFrame, keys: list[str], window: int, literal: bool = False) -> DataFrame:
    """keys, at (from 0), h: hash of each window of ``window`` tokens of ``tok``, as templates or ``literal``; ``window`` is a power of 2.

    Hashes of 1, 2, 4, ... tokens are built from two of half the length, so a token is read once.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of 2")
    d = df.select(*keys, F.transform("tok", lambda x: F.xxhash64(x if literal else _template(x))).alias("h"))
    step = 1
    while step < window:
        d = d.select(*keys, F.zip_with("h", F.slice("h", step + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)).alias("h"))
        step *= 2
    full = F.slice("h", F.lit(1), F.greatest(F.size("h") - (window - 1), F.lit(0)))
    return d.select(*keys, F.posexplode(full).alias("at", "h"))


def _short(texts: DataFrame, items: DataFrame, window: int, least: int) -> DataFrame | None:
    """doc_id, item_id of texts that hold an item of fewer than ``window`` tokens word for word, whole; items of fewer than ``least`` tokens
    must be the whole text."""
    few = items.filter(F.size("tok") < window)
    sizes = [r[0] for r in few.select(F.size("tok")).distinct().collect()]  # fewer than ``window`` numbers
    out = None
    for n in sizes:
        some = few.filter(F.size("tok") == n).select("item_id", F.col("tok").alias("b"), F.xxhash64("tok").alias("h"))
        t = texts.select("doc_id", tokens(F.col("_text")).alias("tok")).filter(F.size("tok") >= n if n >= least else F.size("tok") == n)
        at = F.sequence(F.lit(0), F.size("tok") - n)
        met = t.select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("tok", i + 1, n))))).alias("h")).join(some, "h").select("doc_id", "item_id", "b").distinct()
        # equal hashes are compared word for word
        sure = t.join(met, "doc_id").filter(F.exists(at, lambda i: F.slice("tok", i + 1, n) == F.col("b")))
        slots = F.size(F.filter("b", lambda x: x < _FIRST_WORD))
        one = sure.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), slots.alias("n_slots"), F.lit(0).alias("n_changed"))
        out = one if out is None else out.unionByName(one)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_coverage: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", min_consistent: float = 0.8, slip: int = 8, least: int = 3) -> DataFrame:
    """doc_id, item_id, coverage, n_slots, n_changed: one row per text and benchmark item that it holds.

    A text and an item are aligned where they share a window: as templates, or word for word if the window has more placeholders
    than words. Alignments of one item whose distances (place in the text minus place in the item) follow each other within ``slip`` are also
    taken together: each token of the item is then compared at the distance of the shared window nearest to it (of equally near ones the
    distance that shares most windows, then the smallest), so tokens that are added or dropped do not lose the rest of the item.

    A text holds the item if at least ``min_coverage`` of the item's tokens have equal templates and the slots are consistent: at least
    ``min_consistent`` of them hold the value that the text has most often for the item's value, for names, numbers and units alike. Where the equal
    tokens alone reach ``min_coverage``, slots are not judged. So the item itself, also with a slot altered, and the item with other numbers or names are
    found, a text that merely has the same shape is not. Of several alignments the best is reported. n_changed counts slots whose value
    differs. Items of fewer than ``window`` tokens are held where they stand word for word; of fewer than ``least``, as the whole text.

    Null or empty texts and items give no rows. Rows with a null id are not judged (give them a key of their own, as the pipeline
    does). Repeated rows and repeated items give one row per pair of ids. Other columns are not read, whatever their names.

    The windows of the benchmark are written as a table first, and so are the windows shared and the tokens of the texts that share any; the planner
    broadcasts a table only if its written size is under the session's limit, and shuffles by hash
    otherwise. Alignments are compared exactly, so equal hashes of different windows do no harm.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).filter("doc_id is not null")
    items, _ = scratch.land(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("tok")).filter("item_id is not null and size(tok) > 0"))
    long = items.filter(F.size("tok") >= window)
    words = F.size(F.filter(F.slice("tok", F.col("at") + 1, window), lambda x: x >= _FIRST_WORD))
    own = lambda literal: windows(long, ["item_id", "tok"], window, literal)
    near, _ = scratch.land(own(False).filter(words * 2 >= window).select("item_id", F.col("at").alias("item_at"), "h"))
    dense, _ = scratch.land(own(True).filter(words * 2 < window).select("item_id", F.col("at").alias("item_at"), "h"))

    def shared(of_items, literal):
        every = windows(texts.select("doc_id", tokens(F.col("_text")).alias("tok")), ["doc_id"], window, literal)
        return every.join(of_items, "h").select("doc_id", "item_id", "item_at", (F.col("at") - F.col("item_at")).alias("shift"))

    hits = shared(near, False)
    if not dense.isEmpty():
        hits = hits.unionByName(shared(dense, True))
    hits, _ = scratch.land(hits.distinct())

    by = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    runs = hits.groupBy("doc_id", "item_id", "shift").agg(F.collect_set("item_at").alias("ats"))
    gap = F.col("shift") - F.lag("shift").over(by) > slip
    runs = runs.withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("cluster", F.sum("new").over(by))
    run = F.struct((-F.size("ats")).alias("few"), "shift", "ats")
    one = runs.select("doc_id", "item_id", F.array(run).alias("runs"))
    together = runs.groupBy("doc_id", "item_id", "cluster").agg(F.collect_list(run).alias("runs")).filter(F.size("runs") > 1).select("doc_id", "item_id", "runs")
    # written, so that the planner knows its size before it chooses how the texts meet it
    ids, _ = scratch.land(hits.select("doc_id").distinct())
    held, _ = scratch.land(texts.join(ids, "doc_id", "left_semi").select("doc_id", tokens(F.col("_text")).alias("d")))

    def shift_at(i):
        away = lambda r: F.array_min(F.transform(r["ats"], lambda a: F.greatest(a - i, i - a - (window - 1), F.lit(0))))
        best = F.array_min(F.transform("runs", lambda r: F.struct(away(r).alias("away"), r["few"].alias("few"), r["shift"].alias("shift"))))["shift"]
        return F.when(F.size("runs") == 1, F.get("runs", 0)["shift"]).otherwise(best)

    both = one.unionByName(together).join(held, "doc_id").join(long.withColumnRenamed("tok", "b"), "item_id")
    place = F.transform("b", lambda x, i: F.struct(x.alias("b"), (i + shift_at(i)).alias("at")))
    pairs = F.transform(place, lambda p: F.struct(p["b"].alias("b"), F.when(p["at"] >= 0, F.get("d", p["at"])).alias("d")))
    agree = F.filter(pairs, lambda p: _template(p["b"]).eqNullSafe(_template(p["d"])))
    both = both.select("doc_id", "item_id", F.size("b").alias("n"), agree.alias("agree"))
    slots = F.filter("agree", lambda p: p["b"] < _FIRST_WORD)
    both = both.select("doc_id", "item_id", (F.size("agree") / F.col("n")).alias("coverage"),
                       (F.size(F.filter("agree", lambda p: p["b"] == p["d"])) / F.col("n")).alias("literal"), slots.alias("slots"))
    both, _ = scratch.land(both.filter(F.col("coverage") >= min_coverage))  # the few to be judged; each slot list is read many times
    kinds = F.array_distinct("slots")
    one = lambda side: F.array_distinct(F.transform("slots", lambda p: p[side]))
    # slots that hold the text's most frequent value for the item's value
    times = lambda q: F.size(F.filter("slots", lambda p: p == q))
    follow = F.aggregate(one("b"), F.lit(0), lambda n, x: n + F.array_max(F.transform(F.filter(kinds, lambda q: q["b"] == x), times)))
    most = F.size("slots") - (F.size(kinds) - F.size(one("b")))  # never less than follow, and cheap
    found = both.filter((F.col("literal") >= min_coverage) | ((most >= F.size("slots") * min_consistent) & (follow >= F.size("slots") * min_consistent))).select(
        "doc_id", "item_id", "coverage", F.size("slots").alias("n_slots"), F.size(F.filter("slots", lambda p: p["b"] != p["d"])).alias("n_changed"))
    short = _short(texts, items, window, least)
    if short is not None:
        found = found.unionByName(short)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", (-F.col("n_changed")).alias("same"), "n_slots")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.coverage").alias("coverage"), F.col("x.n_slots").cast("long").alias("n_slots"), (-F.col("x.same")).cast("long").alias("n_changed"))


def query(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_tokens(text: str) -> str:
    """The tokens of a text in DuckDB's SQL; the marks are written as chr(1) to chr(4)."""
    def q(p):
        return "'" + p.replace("'", "''") + "'"

    t = f"regexp_replace(coalesce({text}, ''), {q(NAME_AT)}, '\\1 ' || chr(1) || '\\2', 'g')"
    point = t
    for _ in range(2):
        point = f"regexp_replace({point}, {q(POINT)}, '\\1' || chr(4) || '\\2', 'g')"
    number = f"regexp_replace({point}, {q(NUMBER)}, ' ' || chr(2) || '\\1 ', 'g')"
    unit = f"regexp_replace(lower({number}), {q(UNIT_AT)}, '\\1' || chr(3) || '\\2\\3', 'g')"
    return f"list_filter(regexp_split_to_array({unit}, {q(SPLIT)}), lambda x: x <> '')"


def oracle(window: int = 8, min_coverage: float = 0.7, min_consistent: float = 0.8, slip: int = 8, least: int = 3) -> str:
    """DuckDB SQL for ``query``: windows and short items are compared as text instead of by hash, alignments position by position."""
    tpl = "CASE WHEN {x} < chr(5) THEN {x}[1:1] ELSE {x} END"
    kept = "row_number() OVER () AS rid"
    cut = f"""SELECT {{key}}, p, count(*) OVER w AS n, sum(CASE WHEN x >= chr(5) THEN 1 ELSE 0 END) OVER w AS words, string_agg({tpl.format(x='x')}, ' ') OVER w AS cut,
      chr(7) || string_agg(x, ' ') OVER w AS exact FROM {{src}} WINDOW w AS (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)"""
    return f"""
WITH d AS MATERIALIZED (SELECT {kept}, doc_id, {_sql_tokens('text')} AS tok FROM documents WHERE doc_id IS NOT NULL),
b AS MATERIALIZED (SELECT {kept}, item_id, {_sql_tokens('text')} AS tok FROM benchmark WHERE item_id IS NOT NULL),
dt AS MATERIALIZED (SELECT rid, doc_id, unnest(tok) AS x, unnest(range(1, len(tok) + 1)) AS p FROM d),
bt AS MATERIALIZED (SELECT rid, item_id, len(tok) AS n_tok, unnest(tok) AS x, unnest(range(1, len(tok) + 1)) AS p FROM b),
dk AS MATERIALIZED ({cut.format(key='doc_id', src='dt')}),
bk AS ({cut.format(key='item_id', src='bt')}),
dw AS (SELECT doc_id, p, cut AS w FROM dk WHERE n = {window} UNION ALL SELECT doc_id, p, exact FROM dk WHERE n = {window} AND 2 * words < {window}),
bw AS (SELECT item_id, p, CASE WHEN 2 * words >= {window} THEN cut ELSE exact END AS w FROM bk WHERE n = {window}),
hits AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, bw.p AS spot, dw.p - bw.p AS shift FROM dw JOIN bw USING (w)),
runs AS (SELECT doc_id, item_id, shift, count(*) AS n FROM hits GROUP BY 1, 2, 3),
marked AS (SELECT *, CASE WHEN shift - lag(shift) OVER w <= {slip} THEN 0 ELSE 1 END AS new FROM runs WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY shift)),
clusters AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id ORDER BY shift) AS c FROM marked),
cand AS (SELECT doc_id, item_id, shift, n, 's' || shift AS cid FROM clusters UNION ALL SELECT doc_id, item_id, shift, n, 'c' || c FROM clusters),
near AS (SELECT doc_id, item_id, cid, i, min([greatest(spot - i, i - spot - {window - 1}, 0), -n, shift])[3] AS shift
         FROM (SELECT cand.*, hits.spot, bt.p AS i FROM cand JOIN hits USING (doc_id, item_id, shift) JOIN bt USING (item_id)) GROUP BY 1, 2, 3, 4),
agree AS (SELECT near.doc_id, near.item_id, cid, n_tok AS n, bt.x AS x, dt.x AS y FROM near JOIN bt ON bt.item_id = near.item_id AND bt.p = near.i JOIN dt ON dt.doc_id = near.doc_id AND dt.p = near.i + near.shift
          WHERE {tpl.format(x='bt.x')} = {tpl.format(x='dt.x')}),
slots AS (SELECT doc_id, item_id, cid, x, max(k) AS k FROM (SELECT doc_id, item_id, cid, x, y, count(*) AS k FROM agree WHERE x < chr(5) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
follow AS (SELECT doc_id, item_id, cid, sum(k) AS f FROM slots GROUP BY 1, 2, 3),
sums AS (SELECT doc_id, item_id, cid, count(*) / any_value(n) AS coverage, count(*) FILTER (x = y) / any_value(n) AS literal, count(*) FILTER (x < chr(5)) AS n_slots,
         count(*) FILTER (x < chr(5) AND x <> y) AS n_changed FROM agree GROUP BY 1, 2, 3),
short AS (SELECT doc_id, item_id, 1.0 AS coverage, len(list_filter(b.tok, lambda x: x < chr(5))) AS n_slots, 0 AS n_changed FROM d JOIN b
          ON len(b.tok) BETWEEN 1 AND {window - 1} AND (d.tok = b.tok OR (len(b.tok) >= {least} AND contains(chr(6) || array_to_string(d.tok, chr(6)) || chr(6), chr(6) || array_to_string(b.tok, chr(6)) || chr(6))))),
found AS (SELECT doc_id, item_id, coverage, n_slots, n_changed FROM sums LEFT JOIN follow USING (doc_id, item_id, cid)
          WHERE coverage >= {min_coverage} AND (literal >= {min_coverage} OR coalesce(f, 0) >= {min_consistent} * n_slots) UNION ALL SELECT * FROM short)
SELECT doc_id, item_id, coverage, CAST(n_slots AS BIGINT) AS n_slots, CAST(n_changed AS BIGINT) AS n_changed
FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY coverage DESC, n_changed, n_slots DESC) = 1
"""
