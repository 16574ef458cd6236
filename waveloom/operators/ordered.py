"""Positions, running totals, ranks and exact quantiles that stay spread when one key holds most rows.

A plain window gathers a whole key in one task. Here, at every size, the rows are range partitioned by
(key, order), so a heavy key spans many partitions; every partition is numbered or totalled on its own,
and the small table of per-partition totals carries the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.exprs import c, over
from .landing import land

_LOW = (1 << 33) - 1

def _spread(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Range partition and sort, then fix each row's partition and place by writing them down."""
    cols = [c(k) for k in keys] + [c(o) for o in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return (
        land(placed.withColumn("_rid", F.monotonically_increasing_id()))
        .withColumn("_pid", F.shiftright("_rid", 33))
        .withColumn("_idx", F.col("_rid").bitwiseAND(F.lit(_LOW)))
        .drop("_rid")
    )


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str], hint: str | None = None) -> DataFrame:
    """Inner join on null-safe key equality that keeps the keys of ``a`` once."""
    b = b.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[x for x in b.columns if x not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    if hint:
        b = b.hint(hint)
    return a.join(b, on).drop(*[f"_k_{i}" for i in range(len(keys))])


def _place_in_key(n_keys: int):
    """Arrow function over sorted rows of one partition: adds each row's place among the rows of its key there; the keys come first."""

    def differs(a, b) -> np.ndarray:
        both = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
        if pa.types.is_floating(a.type):
            both = pc.and_not(both, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        return both.to_numpy(zero_copy_only=False)

    def place(batches):
        last, run = None, 0  # keys of the row before, and how many rows of that key came so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in range(n_keys):
                v = batch.column(k)
                before = pa.concat_arrays([last[k] if last else v.slice(0, 1), v.slice(0, n - 1)])
                new |= differs(v, before)
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(new, row, -1))
            at = np.where(start >= 0, row - start, run + row)
            run, last = int(at[-1]) + 1, [batch.column(k).slice(n - 1, 1) for k in range(n_keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "_at"])

    return place


def positions(df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "pos", keep: Sequence | None = None) -> DataFrame:
    """0-based position of each row inside its key. ``keep`` lists the columns (besides the keys) that are written, all if None.

    Rows move once, to their range, and are written once with their place among the rows of their key in the partition. Only the first key of a
    partition can have rows in earlier ones, so one number per partition, broadcast, completes the positions.
    """
    cols = [c(k) for k in keys] + [c(o) for o in order]
    kept = [*keys, *([x for x in df.columns if x not in keys] if keep is None else keep)]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).select(*kept, F.shiftright(F.monotonically_increasing_id(), 33).alias("_pid"))
    placed = land(placed.mapInArrow(_place_in_key(len(keys)), StructType([*placed.schema.fields, StructField("_at", LongType())])))
    parts = placed.groupBy("_pid", *keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(over(list(keys), F.col("_pid")).rowsBetween(Window.unboundedPreceding, -1))
    # at most one row per partition: bounded by the shuffle width, not by the data
    carry = land(parts.withColumn("_before", before).filter("_before > 0").select("_pid", *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], "_before").coalesce(1))
    on = placed["_pid"] == carry["_pid"]
    for i, k in enumerate(keys):
        on = on & placed[k].eqNullSafe(carry[f"_k_{i}"])
    done = placed.join(F.broadcast(carry), on, "left")
    rest = [x for x in placed.columns if x not in ("_pid", "_at")]
    return done.select(*[placed[x] for x in rest], (placed["_at"] + F.coalesce(carry["_before"], F.lit(0))).cast("long").alias(name))


_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], order: Sequence, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running sum, min or max up to and including each row, per key in the given order.

    ``totals`` maps an output name to ('sum' | 'min' | 'max', column). The order must be unique
    inside a key: aggregate equal order values first.
    """
    src = df.select("*", *[col.alias(f"_v_{name}") for name, (_, col) in totals.items()])
    placed = _spread(src, keys, order)
    here = over(["_pid", *keys], F.col("_idx")).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[_MERGE[how](f"_v_{n}").over(here).alias(f"_l_{n}") for n, (how, _) in totals.items()])
    parts = placed.groupBy("_pid", *keys).agg(*[_MERGE[how](f"_v_{n}").alias(f"_p_{n}") for n, (how, _) in totals.items()])
    # one row per (partition, key): a key cannot have more rows here than there are partitions
    prior = over(list(keys), F.col("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_pid", *keys, *[_MERGE[how](f"_p_{n}").over(prior).alias(f"_c_{n}") for n, (how, _) in totals.items()])
    out = _same(local, carry, ["_pid", *keys])
    for n, (how, _) in totals.items():
        lo, up = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        out = out.withColumn(n, lo + F.coalesce(up, F.lit(0)) if how == "sum"
                             else F.least(lo, up) if how == "min" else F.greatest(lo, up))
    drop = ["_pid", "_idx"] + [f"{p}{n}" for n in totals for p in ("_v_", "_l_", "_c_")]
    return out.drop(*drop)


def tie_table(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (key, distinct value): ties, rows before, and running ``sums`` before and at it.

    ``before`` counts smaller values, ``avg_rank`` is the 1-based average rank of the tied rows.
    """
    sums = sums or {}
    ties = df.groupBy(*keys, value).agg(F.count("*").alias("ties"), *[F.sum(col).alias(n) for n, col in sums.items()])
    cum = running(ties, keys, [value], {"_upto": ("sum", F.col("ties")),
                                        **{f"cum_{n}": ("sum", F.col(n)) for n in sums}})
    return (
        cum.withColumn("before", F.col("_upto") - F.col("ties"))
        .withColumn("avg_rank", F.col("before") + (F.col("ties") + 1) / 2)
        .drop("_upto")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of ``probs``."""
    src = df.filter(F.col(value).isNotNull())
    ties = tie_table(src.select(*keys, value), keys, value)
    size = src.groupBy(*keys).agg(F.count("*").alias("_N"))
    t = attach(ties, size, keys)
    v, lo_edge, hi_edge = F.col(value), F.col("before"), F.col("before") + F.col("ties")
    aggs = []
    for name, p in probs.items():
        at = (F.col("_N") - 1) * F.lit(float(p))
        lo, hi = F.floor(at), F.ceil(at)
        aggs += [
            F.max(F.when((lo_edge <= lo) & (lo < hi_edge), v)).alias(f"_lo_{name}"),
            F.max(F.when((lo_edge <= hi) & (hi < hi_edge), v)).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_f_{name}"),
        ]
    out = t.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in probs])


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-key results back to rows. Without keys ``small`` is an aggregate of one row, added to every row."""
    return _same(df, small, keys) if keys else df.join(F.broadcast(small), F.lit(True))
