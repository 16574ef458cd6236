"""Query registry: one Spark callable, one output layout, and (where it exists) one SQL text per query."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import VIEW_SQL, Tables

QUERIES: dict[str, tuple] = {}

_SPARK = {"i": "bigint", "s": "string", "b": "boolean"}


def _layout(cols: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in cols.split()]


def query(name: str, cols: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``.

    ``cols`` lists the output as ``name:type`` with i = bigint, s = string, b = boolean and
    d = double rounded to 6 digits (d3 = to 3 digits).
    """

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = (fn, _layout(cols), sql)
        return fn

    return deco


def _spark_col(name: str, kind: str):
    if kind[0] == "d":
        return F.round(F.col(name).cast("double"), int(kind[1:] or 6)).alias(name)
    return F.col(name).cast(_SPARK[kind]).alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind[0] == "d":
        return f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + CAST(0 AS DOUBLE) AS {name}"
    kind = {"i": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}[kind]
    return f"CAST({name} AS {kind}) AS {name}"


def _needed(sql: str) -> list[str]:
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for v in VIEW_SQL:
            if v not in found and re.search(rf"\b{v}\b", text):
                found.add(v)
                queue.append(VIEW_SQL[v])
    return [v for v in VIEW_SQL if v in found]


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    fn, layout, _ = QUERIES[name]
    return fn(Tables(spark, sf_dir)).select(*[_spark_col(*col) for col in layout])


def full_sql(name: str) -> str | None:
    _, layout, sql = QUERIES[name]
    if sql is None:
        return None
    ctes = [f"{v} AS ({VIEW_SQL[v]})" for v in _needed(sql)] + [f"q_ AS ({sql})"]
    return f"WITH {', '.join(ctes)} SELECT {', '.join(_sql_col(*col) for col in layout)} FROM q_"
