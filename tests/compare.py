"""Compare registered queries with DuckDB: python tests/compare.py [sf] [name pattern]."""

from __future__ import annotations

import glob
import math
import os
import re
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for the workers


def session():
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master("local[8]").appName("waveloom-tests")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
            .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC").getOrCreate())


def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'; SET threads=8")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _key(row):
    return tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in row)


def differences(got, want, cols_got, cols_want, tol=2e-6):
    if sorted(cols_got) != sorted(cols_want):
        return f"columns {sorted(cols_got)} != {sorted(cols_want)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    order = [cols_want.index(c) for c in cols_got]
    a = sorted((tuple(_cell(v) for v in r) for r in got), key=lambda r: str(_key(r)))
    b = sorted((tuple(_cell(r[i]) for i in order) for r in want), key=lambda r: str(_key(r)))
    exact = 0
    for x, y in zip(a, b):
        for c, u, v in zip(cols_got, x, y):
            if u == v:
                continue
            if isinstance(u, float) and isinstance(v, float) and abs(u - v) <= tol * max(1, abs(u)):
                exact += 1
                continue
            return f"{c}: {u!r} != {v!r}\n   got  {dict(zip(cols_got, x))}\n   want {dict(zip(cols_got, y))}"
    return f"~{exact} cells differ in the last digit" if exact else ""


def check(spark, con, name, sf_dir):
    from waveloom.plans import catalog

    t0 = time.time()
    df = catalog.run(name, spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = catalog.sql_texts().get(name)
    if sql is None:
        return len(got), t1 - t0, 0.0, None
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    return len(got), t1 - t0, time.time() - t1, differences(got, want, df.columns, want_cols)


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = sys.argv[2] if len(sys.argv) > 2 else "."
    from waveloom.plans import catalog

    d = f"/root/testdata/sf{sf}"
    spark, con = session(), database(d)
    spark.sparkContext.setLogLevel("ERROR")
    bad, total = [], 0.0
    names = [n for n in catalog.QUERIES if re.search(pattern, n)]
    for n in names:
        try:
            rows, ts, td, diff = check(spark, con, n, d)
            total += ts
            state = "rows-only" if diff is None else "ok" if not diff else diff
            if rows == 0:
                state += "  EMPTY"
        except Exception as e:
            rows, ts, td, state = -1, 0, 0, "ERROR " + str(e)[:900]
        if state not in ("ok", "rows-only"):
            bad.append(n)
        print(f"{n:42s} {rows:7d} {ts:6.2f}s {td:5.2f}s {state}", flush=True)
    print(f"{len(names)} queries, {len(bad)} not clean, {total:.1f}s: {bad}")
