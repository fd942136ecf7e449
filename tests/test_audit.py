
import pytest
from pyspark.sql import functions as F

from linklens.config import EventThresholds, EvidenceConfig
from linklens.operators import correlation as K
from linklens.operators import counters as C
from linklens.operators import events as E
from linklens.operators import evidence as V
from linklens.operators import fingerprint as P
from linklens.operators import profile as N
from linklens.operators import quality as Q
from linklens.operators import report as R
from linklens.session import stage
from tests.helpers import IFACE, PROBE, at, debug_run


@pytest.fixture(scope="module")
def run(spark):
    iface, probe, host, runs = debug_run(spark)
    st = E.EventStages(Q.processed_interface(iface, runs), Q.processed_probes(probe))
    return iface, probe, host, runs, st


def test_counter_steps(spark):
    rows = [("R", "eth0", at(0), 0, 500, 250), ("R", "eth0", at(5), 1, 20, 5)]
    df = spark.createDataFrame(rows, "run_id string, interface string, timestamp timestamp_ntz, row_no long, rx_bytes long, tx_bytes long")
    first, second = C.counter_delta(df, {"tx_bytes": 255}).orderBy("row_no").collect()
    assert first.counter_event == "initial" and first.rx_bytes_delta is None
    assert second.rx_bytes_delta is None and second.tx_bytes_delta == 11
    assert second.counter_event == "overflow+reset"


def test_rates_span_a_row_in_error(spark):
    base = dict(run_id="R", interface="eth0")
    rows = [(0, 0, None, None, "ok"), (1, 10, None, None, "error"), (2, 20, 20_000_000, 10_000_000, "ok")]
    df = spark.createDataFrame(
        [("R", "eth0", at(s), i, rx, tx, 0, 0, 0, 0, "normal", ok) for i, s, rx, tx, ok in rows], IFACE)
    last = Q.processed_interface(df).orderBy("row_no").collect()[2]
    assert (last.elapsed_seconds, last.rx_rate_mbps, last.tx_rate_mbps, last.utilization_pct) == (20.0, 8.0, 4.0, None)
    assert base["run_id"] == last.run_id


def test_interface_summary_uses_only_explicit_capacity(spark):
    rows = [("R", "eth0", at(10 * i), i, rx, tx, 0, 0, 0, 0, "normal", "ok")
            for i, (rx, tx) in enumerate([(None, None), (10_000_000, 5_000_000), (20_000_000, 10_000_000)])]
    df = spark.createDataFrame(rows, IFACE)
    runs = spark.createDataFrame([("R", 20.0)], "run_id string, capacity_mbps double")
    row = Q.interface_summary(Q.processed_interface(df, runs)).collect()[0]
    assert row.rx_rate_mean_mbps == pytest.approx(12.0) and row.tx_rate_mean_mbps == pytest.approx(6.0)
    assert row.utilization_mean_pct == pytest.approx(60.0) and row.utilization_p95_pct == pytest.approx(78.0)
    assert row.utilization_max_pct == pytest.approx(80.0)


def test_probe_summary_counts_loss_and_interpolates(spark):
    rows = [("R", "t", "10.0.0.1", at(5 * i), i, 1, got, None, got > 0, rtt, None, "ok")
            for i, (got, rtt) in enumerate([(1, 10.0), (1, 20.0), (0, None), (1, 30.0)])]
    row = Q.probe_summary(Q.processed_probes(spark.createDataFrame(rows, PROBE))).collect()[0]
    assert (row.loss_percent, row.availability_observed_pct, row.rtt_median_ms) == (25.0, 75.0, 20.0)
    assert row.rtt_p95_ms == pytest.approx(29.0) and row.rtt_p99_ms == pytest.approx(29.8)


def test_delay_variation_skips_lost_probes(spark):
    df = spark.createDataFrame([("R", "t", at(0), 0, 10.0), ("R", "t", at(5), 1, None), ("R", "t", at(10), 2, 16.0)],
                               "run_id string, target string, timestamp timestamp_ntz, row_no long, rtt_ms double")
    got = [r.delay_variation_ms for r in C.delay_variation(df).orderBy("row_no").collect()]
    assert got == [None, None, 6.0]


def test_ping_text_in_two_languages(spark):
    texts = ["Reply time<1ms TTL=64\nPackets: Sent = 4, Received = 3, Lost = 1 (25% loss),",
             "tiempo=18,5ms TTL=57\nEstadísticas\nPaquetes: enviados = 4, recibidos = 4, perdidos = 0",
             "64 bytes ttl=64 time=12.5 ms\n", "nothing useful", "2 packets transmitted, 5 received"]
    df = spark.createDataFrame([("R", "t", at(i), i, 2, 32, t) for i, t in enumerate(texts)],
                               "run_id string, target string, timestamp timestamp_ntz, row_no long, count_per_target int, "
                               "payload_bytes int, output string")
    got = [(r.packets_sent, r.packets_received, r.rtt_ms) for r in C.parse_probe_logs(df).orderBy("row_no").collect()]
    assert got == [(4, 3, 0.5), (4, 4, 18.5), (2, 1, 12.5), (2, 0, None), (2, 0, None)]


def test_one_event_with_five_metrics(run):
    *_, st = run
    row = st.events.collect()[0]
    assert (row.event_id, row.start, row.end) == ("EVENT-001", at(80), at(95))
    assert row.metrics_changed == ["delay_variation", "drops", "packet_loss", "rtt", "utilization"]
    assert (row.severity, row.confidence, row.anomalous_buckets, row.duration_seconds) == ("critical", "ALTA", 3, 15.0)
    assert [r.target for r in st.targets.collect()] == ["external_reference"]


def test_unknown_capacity_fires_the_rate_instead(spark):
    iface, probe, _, runs = debug_run(spark, capacity=None)
    st = E.EventStages(Q.processed_interface(iface, runs), Q.processed_probes(probe))
    assert "traffic_rate" in st.events.collect()[0].metrics_changed


def test_a_single_metric_is_no_event_unless_asked(spark):
    iface, probe, _, runs = debug_run(spark)
    quiet = probe.withColumns({"rtt_ms": F.lit(12.0), "delay_variation_ms": F.lit(1.0), "packets_received": F.lit(100).cast("long")})
    still = iface.withColumn("rx_drops_delta", F.lit(0).cast("long"))
    args = Q.processed_interface(still, runs), Q.processed_probes(quiet)
    assert E.analyze_events(*args).count() == 0
    only = E.analyze_events(*args, EventThresholds(min_metrics_changed=1)).collect()
    assert [r.metrics_changed for r in only] == [["utilization"]]


def test_sources_without_overlap_give_no_events(spark):
    iface, probe, _, runs = debug_run(spark)
    later = probe.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 DAY"))
    st = E.EventStages(Q.processed_interface(iface, runs), Q.processed_probes(later))
    assert st.events.count() == 0
    meta = E.event_metadata(st.timeline, st.buckets, st.overlap).collect()[0]
    assert (meta.event_detection_executed, meta.event_count) == (False, 0)


def test_merge_gap_splits_events(spark):
    iface, probe, _, runs = debug_run(spark, samples=40, anomalies=(10, 12, 30))
    events = E.analyze_events(Q.processed_interface(iface, runs), Q.processed_probes(probe)).orderBy("start").collect()
    assert [(r.event_id, r.anomalous_buckets) for r in events] == [("EVENT-001", 2), ("EVENT-002", 1)]


def test_relations_keep_a_row_when_unavailable(spark, run):
    *_, st = run
    rows = {r.relation_id: r for r in K.analyze_correlations(st.interface, st.probes).collect()}
    assert len(rows) == 6
    assert rows["cpu__rtt__external_reference"].evidence_status == "unavailable"
    assert rows["cpu__rtt__external_reference"].pair_count == 0
    assert rows["utilization__rtt__external_reference"].direction == "positive"


def test_correlation_states(spark):
    def series(n, rtt):
        iface = [("R", "eth0", at(5 * i), i, int((20 + i) * 1e6 * 5 / 8), 0, 0, 0, 0, 0, "normal", "ok") for i in range(n)]
        probe = [("R", "t", "a", at(5 * i), i, 1, 1, 0.0, True, float(rtt(i)), None, "ok") for i in range(n)]
        runs = spark.createDataFrame([("R", 100.0)], "run_id string, capacity_mbps double")
        found = K.analyze_correlations(Q.processed_interface(spark.createDataFrame(iface, IFACE), runs),
                                       Q.processed_probes(spark.createDataFrame(probe, PROBE)))
        return {r.relation_id: r for r in found.collect()}

    rising = series(24, lambda i: 10 + i)["utilization__rtt__t"]
    assert rising.strength == "very_strong" and rising.spearman_rho == pytest.approx(1.0)
    assert series(24, lambda i: 10)["utilization__rtt__t"].evidence_status == "constant_series"
    assert series(8, lambda i: 10 + i)["utilization__rtt__t"].evidence_status == "insufficient_samples"


def correlation(spark, **over):
    row = dict(run_id="R1", relation_id="utilization__rtt__external_reference", x_metric="utilization_pct", y_metric="rtt_ms",
               target="external_reference", pair_count=24, spearman_rho=0.9, abs_rho=0.9, direction="positive",
               strength="very_strong", sufficient_samples=True, evidence_status="descriptive_association",
               descriptive_significance="adequate_descriptive", first_timestamp=at(0), last_timestamp=at(120),
               causal_interpretation_allowed=False, note="")
    from linklens.sources.readers import CORRELATION_SCHEMA
    return spark.createDataFrame([tuple({**row, **over}.values())], CORRELATION_SCHEMA)


def test_strong_support_raises_confidence(spark, run):
    *_, st = run
    row = V.analyze_evidence(st.events, st.targets, correlation(spark)).collect()[0]
    assert (row.confidence, row.supporting_correlation_count, row.causal_claim_allowed) == ("ALTA", 1, False)
    assert "external_reference" in row.interpretation


@pytest.mark.parametrize("over", [
    dict(first_timestamp=at(7200), last_timestamp=at(9000)), dict(target="other"), dict(y_metric="errors_delta")])
def test_no_overlap_other_target_or_other_metric_is_no_support(spark, run, over):
    *_, st = run
    row = V.analyze_evidence(st.events, st.targets, correlation(spark, **over)).collect()[0]
    assert (row.confidence, row.supporting_correlation_count) == ("MEDIA", 0)


def test_weak_correlations_are_context(spark, run):
    *_, st = run
    refs = V.event_correlations(st.events, st.targets, correlation(spark, spearman_rho=0.4), EvidenceConfig())
    found = V.findings(st.events, st.targets, V.top_correlations(refs))
    assert found.collect()[0].context_correlation_count == 1
    assert [r.source_type for r in V.evidence_trace(found, V.top_correlations(refs)).orderBy("source_type").collect()] == [
        "context_correlations", "event"]


def signals(spark, loss_base=0.0, rtt_base=14.0):
    rows = [("utilization", None, 91.0, 58.0), ("rtt", "ext", 49.0, rtt_base), ("delay_variation", "ext", 15.0, 2.0),
            ("packet_loss", "ext", 1.3, loss_base), ("drops", None, 20.0, None)]
    second = [("drops", None, 27.0, None)]
    data = [("R", "EVENT-001", at(0), *r) for r in rows] + [("R", "EVENT-001", at(5), *r) for r in second]
    evidence = spark.createDataFrame(data, "run_id string, event_id string, timestamp timestamp_ntz, metric string, target string, "
                                     "observed double, baseline double")
    events = spark.createDataFrame(
        [("R", "EVENT-001", at(0), at(446), 446.0, "critical", "ALTA", ["delay_variation", "drops", "packet_loss", "rtt", "utilization"])],
        "run_id string, event_id string, start timestamp_ntz, end timestamp_ntz, duration_seconds double, severity string, "
        "confidence string, metrics_changed array<string>")
    return events, E.event_targets(evidence), evidence


def test_fingerprint_vector(spark):
    row = P.analyze_fingerprints(*signals(spark)).collect()[0]
    assert (row.delta_utilization_pp, row.delta_rtt_pct, row.delta_delay_variation_pct) == (33.0, 250.0, 650.0)
    assert (row.delta_loss_pp, row.delta_drops, row.duration_seconds, row.core_completeness_pct) == (1.3, 47.0, 446.0, 100.0)
    assert row.fingerprint_id == "FP-EVENT-001" and row.limitations == []
    again = P.analyze_fingerprints(*signals(spark)).collect()[0]
    assert row.fingerprint_sha256 == again.fingerprint_sha256


def test_fingerprint_without_loss_baseline(spark):
    row = P.analyze_fingerprints(*signals(spark, loss_base=None)).collect()[0]
    assert row.delta_loss_pp is None and row.observed_loss_peak_pct == 1.3 and len(row.limitations) == 1
    base = spark.createDataFrame([("R", "ext", 0.2)], "run_id string, target string, base_loss_pct double")
    assert P.analyze_fingerprints(*signals(spark, loss_base=None), base).collect()[0].delta_loss_pp == 1.1


def test_fingerprint_zero_baseline_falls_back_to_the_difference(spark):
    events, targets, evidence = signals(spark, rtt_base=0.0)
    assert P.analyze_fingerprints(events, targets, evidence).collect()[0].delta_rtt_pct is None
    row = P.fingerprint_extremes(P.fingerprint_trace(evidence)).where("metric = 'rtt'").collect()[0]
    assert (row.delta, row.delta_abs, row.peak) == (None, 49.0, 49.0)


def gate_of(iface, probe, host, runs):
    g = N.QualityStages(iface, host, probe, runs)
    return g, g.gate.collect()[0]


def test_healthy_run_passes(run):
    iface, probe, host, runs, _ = run
    g, row = gate_of(iface, probe, host, runs)
    assert (row.status, row.safe_for_conclusions, row.temporal_integrity_pct) == ("PASS", True, 100.0)
    assert (row.expected_rows_total, row.actual_rows_total, row.valid_rows_total, row.gaps_total) == (72, 72, 72, 0)
    assert g.checks.count() == 18


def test_damaged_runs_warn(spark, run):
    iface, probe, host, runs, _ = run
    _, gap = gate_of(iface.where("row_no <> 10"), probe, host, runs)
    assert gap.status == "WARN" and gap.gaps_total == 1
    copied = probe.unionByName(probe.where("row_no = 5").withColumn("row_no", F.lit(100).cast("long")))
    _, dup = gate_of(iface, copied, host, runs)
    assert dup.duplicates_total == 1 and dup.out_of_order_total == 1


def test_blocking_faults(spark, run):
    iface, probe, host, runs, _ = run
    for parts in ((iface.withColumn("interface", F.lit("wlan0")), probe, host, runs),
                  (iface, probe.withColumn("packets_received", F.lit(200).cast("long")), host, runs),
                  (iface, probe, host.withColumn("timestamp", F.when(F.col("row_no") != 3, F.col("timestamp").cast("string")).otherwise("bad")), runs)):
        _, row = gate_of(*parts)
        assert (row.status, row.safe_for_conclusions) == ("FAIL", False)


def test_rows_outside_the_run_window_warn(spark, run):
    iface, probe, host, runs, _ = run
    early = runs.withColumn("ended", F.lit(at(60)).cast("timestamp_ntz"))
    g, row = gate_of(iface, probe, host, early)
    assert row.status == "WARN"
    assert g.profile.where("outside_run_window > 0").count() == 3


def report_of(iface, probe, host, runs, st):
    g = N.QualityStages(iface, host, probe, runs)
    found = K.analyze_correlations(st.interface, st.probes, host)
    findings = stage(V.analyze_evidence(st.events, st.targets, found))
    prints = P.analyze_fingerprints(st.events, st.targets, st.evidence, st.probe_base)
    headline = R.headline_metrics(runs, Q.interface_summary(st.interface), Q.probe_summary(st.probes), st.events)
    text = R.executive_summary(runs, g.gate, headline, R.safe_only(findings, g.gate))
    return R.run_report(runs, g.gate, g.checks, g.profile, headline, text, st.events, findings, prints)


def test_report_holds_the_analysis_only_for_safe_runs(spark, run):
    iface, probe, host, runs, st = run
    sections = {r.section for r in report_of(iface, probe, host, runs, st).collect()}
    assert {"event", "finding", "fingerprint", "headline_metrics", "check", "source"} <= sections
    blocked = report_of(iface.withColumn("interface", F.lit("x")), probe, host, runs, st).collect()
    assert not {"event", "finding", "fingerprint", "headline_metrics"} & {r.section for r in blocked}
    text = [r.payload for r in blocked if r.section == "executive_summary"][0]
    assert "no habilita conclusiones" in text


def test_report_is_deterministic(run):
    first, second = (sorted(report_of(*run).collect()) for _ in range(2))
    assert first == second
