"""Ordered per-key computations that cut long keys into chunks.

A window over ``run_id`` alone would put one run into one task. Here a key is
cut by a pure function of its order column (a time slice or a row-number
slice). Windows run inside a chunk; what crosses a chunk border is one carried
row per chunk, aggregated before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.functions.scalars import is_ntz, micros

# Six hours: a key yields at most 1,460 carried rows per year however many samples it has. Shorter chunks would carry as many rows as
# a key with a sample every few minutes has.
TIME_CHUNK_SECONDS = 21600
ROW_CHUNK = 1 << 16


def time_chunk(df: DataFrame, name: str = "timestamp", seconds: int = TIME_CHUNK_SECONDS) -> Column:
    return F.floor(micros(F.col(name), is_ntz(df, name)) / F.lit(seconds * 1_000_000)).cast("long")


def row_chunk(name: str = "row_no", rows: int = ROW_CHUNK) -> Column:
    return F.floor(F.col(name) / F.lit(rows)).cast("long")


def previous_valid(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                   valid: Column, chunk: Column, out: str = "_prev") -> DataFrame:
    """Adds struct ``out``: ``columns`` of the last valid row strictly before each row, or null."""
    keys, order = list(keys), list(order)
    payload = F.struct(*[F.col(c) for c in columns])
    base = df.withColumn("_chunk", chunk).withColumn("_ok", F.coalesce(valid, F.lit(False)))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = base.withColumn("_local", F.last(F.when(F.col("_ok"), payload), ignorenulls=True).over(inside))
    # Every chunk appears here, also one without valid rows, so the carry passes through it.
    tails = base.groupBy(*keys, "_chunk").agg(
        F.max_by(F.when(F.col("_ok"), payload), F.when(F.col("_ok"), F.struct(*order))).alias("_tail"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select(*keys, "_chunk", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return (local.join(carry, keys + ["_chunk"], "left")
            .withColumn(out, F.coalesce("_local", "_carry"))
            .drop("_chunk", "_ok", "_local", "_carry"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], amounts: dict[str, Column],
                chunk: Column) -> DataFrame:
    """Adds, per ``name -> amount``, the sum up to and including each row."""
    keys, order = list(keys), list(order)
    base = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = base.select("*", *[F.sum(expr).over(inside).alias(f"_in_{name}") for name, expr in amounts.items()])
    totals = base.groupBy(*keys, "_chunk").agg(*[F.sum(expr).alias(f"_t_{name}") for name, expr in amounts.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in amounts])
    joined = local.join(carry, keys + ["_chunk"], "left")
    for name in amounts:
        joined = joined.withColumn(name, F.coalesce(F.col(f"_in_{name}"), F.lit(0)) + F.col(f"_off_{name}"))
    return joined.drop("_chunk", *[f"_in_{n}" for n in amounts], *[f"_off_{n}" for n in amounts])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                out: str = "_rn") -> DataFrame:
    """Adds the 1-based position of each row within its key."""
    return running_sum(df, keys, order, {out: F.lit(1)}, chunk)
