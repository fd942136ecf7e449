"""Hot groups, chunk borders and plan shape."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linklens.operators import history as H
from linklens.operators import ingest as I
from linklens.operators.ordered import previous_valid, row_chunk, row_numbers, time_chunk
from linklens.operators.quantiles import bounded_quantiles, exact_quantiles
from linklens.operators.ranks import average_ranks, bounded_spearman, dealt_by_range, range_offsets, spearman
from linklens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows in one group, half of one column a single value."""
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"k": key, "a": rng.normal(0, 3, n).round(2), "b": np.where(rng.random(n) < 0.5, 0.0, rng.gamma(2, 20, n)),
                         "i": np.arange(n)})


@pytest.mark.parametrize("way", [exact_quantiles, bounded_quantiles])
def test_both_ways_give_exact_quantiles(spark, skewed, way):
    specs = {"a50": ("a", 0.5), "a95": ("a", 0.95), "b0": ("b", 0.0), "b50": ("b", 0.5), "b99": ("b", 0.99), "b1": ("b", 1.0)}
    got = way(spark.createDataFrame(skewed), ["k"], specs).toPandas().set_index("k").sort_index()
    want = pd.DataFrame({n: skewed.groupby("k")[c].quantile(q) for n, (c, q) in specs.items()})
    assert np.allclose(got[want.columns], want, atol=1e-9)


@pytest.mark.parametrize("way", [exact_quantiles, bounded_quantiles])
def test_groups_of_nulls_and_nan_have_the_same_rows_either_way(spark, way):
    rows = [("none", None), ("none", None), ("nan", float("nan")), ("mixed", float("nan")), ("mixed", 1.0), ("mixed", 2.0), ("mixed", None)]
    got = way(spark.createDataFrame(rows, "k string, v double"), ["k"], {"q": ("v", 0.5)}).collect()
    assert {r.k: r.q for r in got} == {"none": None, "nan": None, "mixed": 1.5}


def test_values_in_a_narrow_range_are_selected_exactly(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": 1, "v": 0.0005 + rng.random(60_000) * 1e-7})
    specs = {f"q{q}": ("v", q) for q in (0.0, 0.001, 0.5, 0.95, 0.999, 1.0)}
    got = exact_quantiles(spark.createDataFrame(frame), ["k"], specs).toPandas().iloc[0]
    for name, (_, q) in specs.items():
        assert got[name] == pytest.approx(frame.v.quantile(q), abs=1e-18)


def test_one_key_is_dealt_over_all_ranges(spark):
    rng = np.random.default_rng(6)
    values = pd.DataFrame({"k": 1, "v": (0.0005 + rng.random(50_000) * 1e-7).round(11)})
    frame = spark.createDataFrame(values)
    dealt = dealt_by_range(frame, ["k"], "v", ranges=16)
    sizes = dealt.groupBy("_range").count().toPandas()["count"]
    assert len(sizes) == 16 and sizes.max() < 3 * sizes.mean()
    assert range_offsets(dealt, ["k"]).count() == 16
    got = average_ranks(frame, ["k"], "v", ranges=16).toPandas().set_index("v").avg_rank
    want = values.assign(r=values.v.rank()).groupby("v").r.first()
    assert np.allclose(got.sort_index(), want, atol=0)


@pytest.mark.parametrize("way", [spearman, bounded_spearman])
def test_both_ways_give_the_same_correlation(spark, skewed, way):
    got = way(spark.createDataFrame(skewed), ["k"], "a", "b").toPandas().set_index("k").sort_index()
    ranks = skewed.groupby("k")[["a", "b"]].rank().assign(k=skewed.k)
    want = ranks.groupby("k")[["a", "b"]].apply(lambda g: np.corrcoef(g.a, g.b)[0, 1])
    assert np.allclose(got.rho, want, atol=1e-9)
    assert (got.y_distinct == skewed.groupby("k").b.nunique()).all()


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("g", v) for v in (5.0, -1.0, 5.0, 7.0, -1.0, 5.0)], "k string, v double")
    got = {r.v: r.avg_rank for r in average_ranks(df, ["k"], "v").collect()}
    assert got == {-1.0: 1.5, 5.0: 4.0, 7.0: 6.0}


@pytest.mark.parametrize("seconds", [1, 3600, 10**9])
def test_previous_valid_crosses_chunk_borders(spark, seconds):
    df = spark.read.parquet(f"{SF}/events.parquet")
    rows = previous_valid(df, ["user_id"], ["ts", "event_id"], ["value"], F.col("event_type") != "error", time_chunk(df, "ts", seconds))
    got = rows.select("user_id", "ts", "event_id", "event_type", "value", F.col("_prev.value").alias("p")).toPandas()
    got = got.sort_values(["user_id", "ts", "event_id"])
    valid = got.value.where(got.event_type != "error")
    want = valid.groupby(got.user_id).transform(lambda c: c.ffill().shift())
    assert np.allclose(got.p.fillna(-1), want.fillna(-1))


@pytest.mark.parametrize("size", [1, 37, 10**6])
def test_row_numbers_cross_chunk_borders(spark, size):
    df = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id")
    got = row_numbers(df, ["user_id"], ["event_id"], row_chunk("event_id", size)).toPandas().sort_values(["user_id", "event_id"])
    assert (got._rn == got.groupby("user_id").cumcount() + 1).all()


def test_a_huge_group_of_copies_keeps_its_first_row(spark):
    df = spark.range(5000).select(F.lit("2026-01-01 00:00:00").alias("timestamp"), F.lit("A").alias("link_id"), F.lit("1").alias("rx_mbps"),
                                  F.lit("1").alias("tx_mbps"), F.lit("9").alias("capacity_mbps"), (F.col("id") + 10).alias("row_no"))
    accepted = I.accepted_rows(I.validate_rows(df)).collect()
    assert [r.row_no for r in accepted] == [10]


def test_events_meet_only_the_correlations_of_their_targets(spark):
    """Many targets per run: what the joins give is what the target rule leaves."""
    from linklens.operators.evidence import event_correlations
    t0 = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    events = spark.range(40).select(F.lit("R").alias("run_id"), F.concat(F.lit("E"), "id").alias("event_id"), t0.alias("start"), t0.alias("end"),
                                    F.array(F.lit("rtt"), F.lit("utilization")).alias("metrics_changed"))
    targets = events.select("run_id", "event_id", F.concat(F.lit("t"), F.substring("event_id", 2, 9)).alias("target")).where("event_id <> 'E0'")
    found = spark.range(200).select(
        F.lit("R").alias("run_id"), F.concat(F.lit("r"), "id").alias("relation_id"), F.concat(F.lit("t"), "id").alias("target"), F.lit("utilization_pct").alias("x_metric"),
        F.lit("rtt_ms").alias("y_metric"), F.lit(50).cast("long").alias("pair_count"), F.lit(0.9).alias("spearman_rho"), F.lit("positive").alias("direction"),
        F.lit("strong").alias("strength"), F.lit("descriptive_association").alias("evidence_status"), F.lit(True).alias("sufficient_samples"),
        t0.alias("first_timestamp"), t0.alias("last_timestamp"), F.lit("").alias("note"))
    assert event_correlations(events, targets, found).count() == 39 + 200  # one target each; the event without targets meets all


def test_only_needed_columns_reach_the_scan(spark):
    daily = H.daily_link(catalog.links(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "props" in daily  # k comes from props
    plan = catalog.QUERIES["source_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and not any("value" in s.split("ReadSchema")[1] for s in scans)


@pytest.mark.parametrize("key", ["validate_rows", "load_delta", "counter_delta", "probe_summary", "chart_series", "gaps",
                                 "table_diff", "verify_manifest", "parse_probe_logs", "systematic_sample"])
def test_plans_have_no_python_rows_cross_joins_or_global_windows(spark, key):
    plan = catalog.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition"):
        assert bad not in plan, bad


def test_difference_limit_is_applied_before_the_shuffle(spark):
    plan = catalog.QUERIES["diff_limit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    before_last_shuffle = plan.split("Exchange SinglePartition")[1] if "Exchange SinglePartition" in plan else plan
    assert "WindowGroupLimit" in before_last_shuffle
