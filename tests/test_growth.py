"""Work that grows no faster than the rows: short groups, carried rows, deltas and evidence computed once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linklens.operators import events as E
from linklens.operators.ordered import time_chunk
from linklens.operators.quantiles import exact_quantiles
from linklens.plans import audit as A
from tests.helpers import debug_run


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("whole", [1, 60, 10**6])
def test_short_and_long_groups_have_the_same_quantiles(spark, whole):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": ["a"] * 5 + ["b"] * 59 + ["c"] * 60 + ["d"] * 900, "v": rng.normal(0, 9, 1024).round(1)})
    frame.loc[::7, "v"] = np.nan
    specs = {"q05": ("v", 0.05), "q50": ("v", 0.5), "q95": ("v", 0.95)}
    got = exact_quantiles(spark.createDataFrame(frame), ["k"], specs, whole).toPandas().set_index("k").sort_index()
    want = pd.DataFrame({n: frame.groupby("k").v.quantile(q) for n, (_, q) in specs.items()})
    assert np.allclose(got[want.columns], want, atol=1e-9)


def test_rows_without_a_key_have_no_quantile(spark):
    rows = [(None, 1.0)] * 3 + [("a", 2.0), ("b", None)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], {"q": ("v", 0.5)}, 2).collect()
    assert sorted((r.k or "", r.q) for r in got) == [("", None), ("a", 2.0), ("b", None)]


def test_a_day_of_a_key_carries_a_handful_of_rows(spark):
    day = spark.range(1440).select(F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("timestamp"))
    assert day.select(time_chunk(day).alias("c")).distinct().count() == 4


def test_an_audit_of_counters_takes_their_deltas_once(spark, monkeypatch):
    interface, probes, host, runs = debug_run(spark)
    raw = interface.drop(*[c for c in interface.columns if c.endswith("_delta")], "counter_event").withColumns(
        {"rx_bytes": F.col("row_no") * 1000, "tx_bytes": F.col("row_no") * 500})
    taken = []
    real = A.counter_delta
    monkeypatch.setattr(A, "counter_delta", lambda *a: taken.append(1) or real(*a))
    monkeypatch.setattr("linklens.operators.quality.counter_delta", lambda *a: taken.append(2) or real(*a))
    rows = A.RunAudit(raw, probes, host, runs).stages.interface.collect()
    assert taken == [1] and {r.rx_bytes_delta for r in rows} == {None, 1000}


def test_evidence_and_targets_are_read_not_joined_again(spark):
    interface, probes, _, runs = debug_run(spark)
    from linklens.operators.quality import processed_interface, processed_probes
    st = E.EventStages(processed_interface(interface, runs), processed_probes(probes))
    assert "Join" not in optimized(st.evidence) and "Join" not in optimized(st.targets)
    assert [(r.run_id, r.target) for r in st.targets.collect()] == [("R1", "external_reference")]
