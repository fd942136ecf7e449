"""A bitmap of fixed size over hashed keys: rows that are surely not wanted are known where they lie, so only the others are moved or verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions of a bitmap, sent to all executors as at most BITS / 64 rows at any number of keys; a full one lets more rows pass, never fewer.
BITS = 1 << 23


def place(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS)).alias("place")


def flagged(rows: DataFrame, keys: DataFrame, **flags: Column) -> DataFrame:
    """``rows`` with a boolean per flag instead of ``place``: true for the places of all ``keys`` with that flag, and for no others' but by chance."""
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = keys.groupBy(F.shiftright("place", 6).alias("mark_word")).agg(
        *[F.bit_or(F.when(flag, bit).otherwise(F.lit(0).cast("long"))).alias(f"marks_{name}") for name, flag in flags.items()])
    held = rows.withColumn("mark_word", F.shiftright("place", 6)).join(F.broadcast(words), "mark_word", "left")
    return held.select(*[c for c in rows.columns if c != "place"],
                       *[F.coalesce(F.expr(f"getbit(marks_{name}, cast(place & 63 as int)) = 1"), F.lit(False)).alias(name) for name in flags])
