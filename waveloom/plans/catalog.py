"""All registered queries."""

from __future__ import annotations

from functools import partial

from . import (  # noqa: F401  each registers its queries
    cluster_queries,
    connect_queries,
    evaluate_queries,
    graph_queries,
    select_queries,
    signal_queries,
    source_queries,
    stats_queries,
)
from .registry import QUERIES, full_sql, run


def callables():
    return {name: partial(_call, name) for name in QUERIES}


def _call(name, spark, sf_dir):
    return run(name, spark, sf_dir)


def sql_texts():
    return {name: full_sql(name) for name in QUERIES if full_sql(name) is not None}


__all__ = ["QUERIES", "callables", "run", "sql_texts"]
