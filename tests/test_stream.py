"""A stream that lands in slices gives what the batch operator gives."""

import pytest
from pyspark.sql import functions as F

from linklens.operators import counters as C
from linklens.plans import fixtures as fx
from linklens.streaming import pipelines as T
from linklens.streaming import stateful as U
from tests.helpers import at

SF = "/root/testdata/sf0.001"


def thirds(df):
    borders = [F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in (11, 21)]
    t = F.col("timestamp")
    return [df.where(t < borders[0]), df.where((t >= borders[0]) & (t < borders[1])), df.where(t >= borders[1])]


def same(left, right):
    columns = sorted(left.columns)
    assert left.count() > 0
    assert left.select(columns).exceptAll(right.select(columns)).count() == 0
    assert right.select(columns).exceptAll(left.select(columns)).count() == 0


def test_counter_state_survives_restarts(spark):
    iface = fx.iface(spark, SF)
    got = T.land_and_run(thirds(iface), lambda s: U.stream_counter_delta(s, fx.COUNTER_MAX))
    same(got, C.counter_delta(iface, fx.COUNTER_MAX).select(got.columns))


def test_delay_variation_state(spark):
    probes = fx.probes(spark, SF)
    got = T.land_and_run(thirds(probes), U.stream_delay_variation)
    same(got, C.delay_variation(probes).select(got.columns))


def test_transitions_state(spark):
    probes = fx.probes(spark, SF)
    same(T.land_and_run(thirds(probes), U.stream_transitions), C.reachability_transitions(probes))


def test_rows_older_than_the_state_do_not_move_it(spark):
    schema = "run_id string, interface string, timestamp timestamp_ntz, row_no long, rx_bytes long, sample_status string"
    slices = [spark.createDataFrame([("R", "e", at(10), 2, 100, "ok")], schema),
              spark.createDataFrame([("R", "e", at(5), 1, 50, "ok"), ("R", "e", at(15), 3, 130, "ok")], schema)]
    got = {r.row_no: (r.rx_bytes_delta, r.counter_event) for r in T.land_and_run(slices, U.stream_counter_delta).collect()}
    assert got == {2: (None, "initial"), 1: (None, "late"), 3: (30, "normal")}


def test_late_rows_are_those_outside_the_window(spark):
    host = fx.host(spark, SF)
    runs = fx.runs(spark, SF).withColumn("ended", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    got = T.land_and_run(thirds(host), lambda s: T.stream_late_rows(s, runs))
    assert got.count() == host.where("timestamp > timestamp_ntz'2024-01-20 00:00:05'").count() > 0


@pytest.mark.parametrize("copies", [1, 3])
def test_dedup_keeps_one_row_per_link_and_instant(spark, copies):
    df = spark.range(20).select(F.concat(F.lit("L"), F.col("id") % 2).alias("link_id"),
                                F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"))
    many = df
    for _ in range(copies - 1):
        many = many.unionByName(df)
    same(T.land_and_run([many], T.stream_dedup), df)


def test_the_first_copy_stays_with_its_other_columns(spark):
    schema = "link_id string, timestamp timestamp_ntz, value long"
    slices = [spark.createDataFrame(rows, schema) for rows in ([("a", at(0), 1), ("b", at(0), 2)], [("a", at(0), 9), ("b", at(5), 3), ("b", at(0), 8)])]
    got = T.land_and_run(slices, T.stream_dedup)
    assert sorted((r.link_id, r.value) for r in got.collect()) == [("a", 1), ("b", 2), ("b", 3)]


def test_dropped_rows_are_counted_over_all_batches(spark):
    """More micro-batches than Spark keeps in its recent progress."""
    schema = "link_id string, timestamp timestamp_ntz"
    new = spark.createDataFrame([("a", at(86400))], schema)
    old = spark.createDataFrame([(f"l{i}", at(i)) for i in range(24)], schema).repartition(8)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        got = T.land_and_count([new, old], T.stream_dedup, max_files=1).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert sum(r.input_rows for r in got) == 25 and sum(r.dropped_by_watermark for r in got if r.landing == 2) == 24
    assert sum(r.dropped_by_watermark for r in got if r.landing == 1) == 0 and len(got) > 6


def test_counters_are_exact_and_null_counters_give_null(spark):
    schema = "run_id string, interface string, timestamp timestamp_ntz, row_no long, rx_bytes long, tx_bytes long, sample_status string"
    big = 1 << 60
    rows = [("R", "e", at(0), 1, big + 1, 5, "ok"), ("R", "e", at(5), 2, None, None, "error"), ("R", "e", at(10), 3, big + 4, None, "ok"),
            ("R", "e", at(15), 4, big + 9, 7, "ok")]
    df = spark.createDataFrame(rows, schema)
    got = T.land_and_run([df.where("row_no < 3"), df.where("row_no >= 3")], U.stream_counter_delta)
    assert {r.row_no: (r.rx_bytes_delta, r.tx_bytes_delta) for r in got.collect()} == {1: (None, None), 2: (None, None), 3: (3, None), 4: (5, None)}
    same(got, C.counter_delta(df).select(got.columns))


def test_late_transitions_are_labelled(spark):
    schema = "run_id string, target string, timestamp timestamp_ntz, row_no long, reachability boolean"
    slices = [spark.createDataFrame([("R", "t", at(10), 2, True)], schema),
              spark.createDataFrame([("R", "t", at(5), 1, False), ("R", "t", at(15), 3, False)], schema)]
    got = {r.row_no: r.transition for r in T.land_and_run(slices, U.stream_transitions).collect()}
    assert got == {1: "late", 3: "became_unreachable"}


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(T.PROVIDER, None)
    T.land_and_run([fx.probes(spark, SF)], U.stream_delay_variation)
    assert spark.conf.get(T.PROVIDER, None) == before
