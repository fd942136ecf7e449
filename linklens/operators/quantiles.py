"""Exact, linearly interpolated quantiles.

Which way is taken depends on what a key means:

* ``bounded_quantiles`` is for keys with a bounded number of rows by nature (a time bucket, a day of one link): one
  ``percentile`` buffer per group, inside one aggregate.
* ``exact_quantiles`` is for keys that grow with history (a link, a run, a target). A mergeable sketch brackets the values
  around each wanted rank; copies of values collapse, everything below a bracket collapses to one row, and only the values inside
  the bracket are ordered. A group of so few rows that its bracket would hold all of them needs no sketch: its values meet in one
  ``percentile`` buffer, which ``WHOLE`` bounds.

Both ignore nulls and NaN, keep a row for a group without values, and interpolate by the same formula.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rank error of the sketch is at most rows / ACCURACY; brackets reach MARGIN times as far on either side.
ACCURACY, MARGIN = 4000, 8
LOWEST = float("-inf")
# Below this many rows a bracket spans its whole group.
WHOLE = 4 * ACCURACY // MARGIN


def number(column: str) -> Column:
    """A double; NaN counts as missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def quantile_of(column: str, q: float) -> Column:
    """Exact quantile as an aggregate; for groups that are bounded by what their key means."""
    return F.percentile(number(column), F.lit(float(q)))


def bounded_quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """``keys`` plus one column per spec ``name -> (value column, q)``."""
    return df.groupBy(*keys).agg(*[quantile_of(c, q).alias(name) for name, (c, q) in specs.items()])


def _interpolated(low: Column, high: Column, position: Column) -> Column:
    below, above = F.floor(position), F.ceil(position)
    return F.when(below == above, low).otherwise((above - position) * low + (position - below) * high)


def exact_quantiles(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]], whole: int = WHOLE) -> DataFrame:
    """``keys`` plus one column per spec ``name -> (value column, q)``; keys must not be null.

    The keys of groups with ``whole`` rows or more are broadcast: at most one for every ``whole`` rows of the input. Their rows are bracketed,
    all others meet in one aggregate whose buffers hold fewer than ``whole`` values a column.
    """
    keys = list(keys)
    there = F.lit(True)
    for k in keys:
        there = there & F.col(k).isNotNull()
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    long = F.broadcast(df.where(there).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= whole).select(*keys))
    slim = df.select(*keys, *[F.when(there, number(c)).alias(f"_v{i}") for i, c in enumerate(columns)])
    at = {c: f"_v{i}" for i, c in enumerate(columns)}
    levels = {c: list(dict.fromkeys(float(q) for name, q in specs.values() if name == c)) for c in columns}
    short = slim.join(long, keys, "left_anti").groupBy(*keys).agg(
        *[F.percentile(at[c], F.array(*map(F.lit, levels[c]))).alias(f"_q{i}") for i, c in enumerate(columns)]).select(
        *keys, *[F.get(f"_q{columns.index(c)}", F.lit(levels[c].index(float(q)))).alias(name) for name, (c, q) in specs.items()])
    bracketed = _bracketed(slim.join(long, keys, "left_semi"), keys, {name: (at[c], q) for name, (c, q) in specs.items()})
    return short.unionByName(bracketed)


def _bracketed(df: DataFrame, keys: Sequence[str], specs: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Two reads of the rows and two aggregates with map-side combining.

    What is ordered per group and spec is the bracket: at most ``2 * MARGIN / ACCURACY`` of the group's rows, or ``4 * ACCURACY / MARGIN`` rows.
    """
    keys, names = list(keys), list(specs)
    columns = list(dict.fromkeys(c for c, _ in specs.values()))
    slim = df.select(*keys, *[number(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    reach = MARGIN / ACCURACY

    def levels(column: str) -> list[float]:
        return [level for c, q in specs.values() if c == column for level in (max(0.0, q - reach), min(1.0, q + reach))]

    sketch = slim.groupBy(*keys).agg(*[a for i, c in enumerate(columns) for a in (
        F.count(f"_v{i}").alias(f"_n{i}"),
        F.percentile_approx(f"_v{i}", F.array(*map(F.lit, levels(c))), F.lit(ACCURACY)).alias(f"_cut{i}"))])
    place: dict[str, int] = {}
    brackets = []
    for name, (c, q) in specs.items():
        i, j = columns.index(c), place.get(c, 0)
        place[c] = j + 1
        # A bracket spans whole ranks: it is open at the ends and where its reach is not yet a few rows.
        wide = F.col(f"_n{i}") * reach >= 4
        low = F.lit(LOWEST) if q - reach <= 0 else F.when(wide, F.get(f"_cut{i}", F.lit(2 * j))).otherwise(F.lit(LOWEST))
        high = F.lit(float("inf")) if q + reach >= 1 else F.when(wide, F.get(f"_cut{i}", F.lit(2 * j + 1))).otherwise(F.lit(float("inf")))
        brackets.append(F.struct(low.alias("low"), high.alias("high"), ((F.col(f"_n{i}") - 1) * F.lit(float(q))).alias("position")))
    borders = sketch.select(*keys, F.array(*brackets).alias("_b"))

    def entry(s: int, name: str) -> Column:
        value, b = F.col(f"_v{columns.index(specs[name][0])}"), F.get("_b", F.lit(s))
        return F.when(value <= b["high"], F.struct(F.lit(s).alias("s"), F.when(value >= b["low"], value).otherwise(F.lit(LOWEST)).alias("v")))

    near = (slim.join(borders, keys)
            .select(*keys, F.explode(F.array_compact(F.array(*[entry(s, n) for s, n in enumerate(names)]))).alias("e"))
            .groupBy(*keys, F.col("e.s").alias("_s"), F.col("e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    upto = W.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = near.withColumn("_end", F.sum("_c").over(upto)).join(borders, keys)
    position = F.get("_b", F.col("_s"))["position"]

    def at(rank: Column) -> Column:
        return (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_c"))

    found = ordered.withColumn("_p", position).where(at(F.floor("_p")) | at(F.ceil("_p")))
    aggregates = []
    for s, name in enumerate(names):
        low, high = (F.max(F.when((F.col("_s") == s) & at(side("_p")), F.col("_v"))) for side in (F.floor, F.ceil))
        aggregates.append(_interpolated(low, high, F.max(F.when(F.col("_s") == s, F.col("_p")))).alias(name))
    return sketch.select(*keys).join(found.groupBy(*keys).agg(*aggregates), keys, "left")
