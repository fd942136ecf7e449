"""Average ranks and rank correlation.

As with quantiles the way depends on what a key means: ``bounded_spearman`` ranks by windows over whole groups (series
of buckets of one run), ``spearman`` deals all distinct values by range of key and value, so that a key that holds most rows is spread over
all tasks; values are counted inside a range and shifted by one offset per range and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.operators.quantiles import number
from linklens.session import stage

def dealt_by_range(values: DataFrame, keys: Sequence[str], value: str = "_v", weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """Copies of a value collapse before they move: staged ``keys, value, _c`` and the number ``_range`` of its range.

    Ranges follow the order of (keys, value); they are drawn by sampling, so the table is written once and every reader sees the same cut.
    """
    keys = list(keys)
    counted = F.sum(weight) if weight else F.count(F.lit(1))
    freq = values.groupBy(*keys, value).agg(counted.alias("_c"))
    order = [*keys, value]
    spread = freq.repartitionByRange(ranges, *order) if ranges else freq.repartitionByRange(*order)
    return stage(spread.withColumn("_range", F.spark_partition_id()), "ranges")


def range_offsets(dealt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows below each range of a key and in all of them: ``keys, _range, _below, _n, _distinct``; a key has at most as many rows as there are ranges."""
    parts = dealt.groupBy(*keys, "_range").agg(F.sum("_c").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    group = W.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_below"),
                        F.sum("_rows").over(group).alias("_n"), F.sum("_values").over(group).alias("_distinct"))


def average_ranks(values: DataFrame, keys: Sequence[str], value: str = "_v", weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """One row per distinct value: ``keys, value, avg_rank, tie_count, n, distinct_values``.

    Ties share the mean of the ranks they cover. Each range is ordered on its own and shifted by the rows below it.
    """
    keys = list(keys)
    dealt = dealt_by_range(values.where(F.col(value).isNotNull()), keys, value, weight, ranges)
    upto = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (dealt.withColumn("_end", F.sum("_c").over(upto)).join(range_offsets(dealt, keys), keys + ["_range"])
            .select(*keys, value, (F.col("_below") + F.col("_end") - (F.col("_c") - 1) / 2.0).alias("avg_rank"),
                    F.col("_c").alias("tie_count"), F.col("_n").alias("n"), F.col("_distinct").alias("distinct_values")))


def _clamped(xy, xx, yy):
    rho = F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx) / F.sqrt(yy))
    return F.when(rho.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rho)))


def complete_pairs(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    return pairs.select(*keys, number(x).alias("x"), number(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def bounded_spearman(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """As ``spearman``, by windows over whole groups: for keys whose groups are bounded. One shuffle on the keys."""
    keys, group = list(keys), W.partitionBy(*keys)
    ranked = complete_pairs(pairs, keys, x, y)
    for c in ("x", "y"):
        ordered = group.orderBy(c)
        ranked = ranked.withColumns({
            f"_r{c}": F.rank().over(ordered) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2.0,
            f"_d{c}": F.dense_rank().over(ordered)})
    stats = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pair_count"), F.max("_dx").cast("long").alias("x_distinct"),
        F.max("_dy").cast("long").alias("y_distinct"), F.covar_pop("_rx", "_ry").alias("_xy"),
        F.var_pop("_rx").alias("_xx"), F.var_pop("_ry").alias("_yy"))
    return stats.select(*keys, "pair_count", "x_distinct", "y_distinct", _clamped(F.col("_xy"), F.col("_xx"), F.col("_yy")).alias("rho"))


def spearman(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """``keys, pair_count, x_distinct, y_distinct, rho`` over complete pairs; ``rho`` is null when a side is constant.

    For groups of any size. Copies of a pair collapse first; both sides are ranked in one pass, as values of two keys. The centred ranks of
    ``x`` are summed per ``y`` value before the ranks of ``y`` are joined, so ties in ``y`` move as one row.
    """
    keys = list(keys)
    copies = stage(complete_pairs(pairs, keys, x, y).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("_w")), "pairs")
    sides = copies.select(*keys, "_w", F.explode(F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).cast("double").alias("_v")) for c in ("x", "y")])).alias("_s")).select(
        *keys, "_w", "_s._side", "_s._v")
    ranks = average_ranks(sides, [*keys, "_side"], "_v", "_w").select(
        *keys, "_side", "_v", (F.col("avg_rank") - (F.col("n") + 1) / 2.0).alias("_r"), F.col("tie_count").alias("_t"), "n", "distinct_values")

    def side(c: str) -> DataFrame:
        return ranks.where(F.col("_side") == c).select(*keys, F.col("_v").alias(c), F.col("_r").alias(f"_r{c}"), F.col("_t").alias(f"_c{c}"),
                                                       F.col("n").alias(f"_n{c}"), F.col("distinct_values").alias(f"_d{c}"))

    rank_x, rank_y = side("x"), side("y")
    by_y = (copies.join(rank_x, keys + ["x"]).groupBy(*keys, "y")
            .agg(F.sum(F.col("_w") * F.col("_rx")).alias("_srx"), F.sum(F.col("_w") * F.col("_rx") * F.col("_rx")).alias("_sxx"), F.max("_dx").alias("_dx")))
    cross = (by_y.join(rank_y, keys + ["y"]).groupBy(*keys)
             .agg(F.max("_ny").alias("pair_count"), F.max("_dx").alias("x_distinct"), F.max("_dy").alias("y_distinct"),
                  F.sum(F.col("_srx") * F.col("_ry")).alias("_xy"), F.sum("_sxx").alias("_xx"),
                  F.sum(F.col("_cy") * F.col("_ry") * F.col("_ry")).alias("_yy")))
    return cross.select(*keys, "pair_count", "x_distinct", "y_distinct", _clamped(F.col("_xy"), F.col("_xx"), F.col("_yy")).alias("rho"))
