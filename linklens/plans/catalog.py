"""Every registered query: a name and a lazy plan over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.config import CorrelationConfig, EventThresholds
from linklens.functions.scalars import loss_pct, rounded
from linklens.operators import correlation as K
from linklens.operators import counters as C
from linklens.operators import events as E
from linklens.operators import evidence as V
from linklens.operators import fingerprint as P
from linklens.operators import history as H
from linklens.operators import ingest as I
from linklens.operators import integrity as G
from linklens.operators import profile as N
from linklens.operators import quality as Q
from linklens.operators import ranks
from linklens.operators import report as R
from linklens.plans import fixtures as fx
from linklens.plans.audit import RunAudit
from linklens.session import scratch_dir, stage, together
from linklens.sources import files as X
from linklens.sources import readers as S
from linklens.sources import sinks as W
from linklens.streaming import pipelines as T
from linklens.streaming import stateful as U

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(key: str, digits: int = 6):
    def register(build: Query) -> Query:
        QUERIES[key] = lambda spark, sf_dir: rounded(build(spark, sf_dir), digits)
        return build
    return register


# --- ingest and history ------------------------------------------------------

SPANISH = {"timestamp": "Fecha", "link_id": "Enlace", "rx_mbps": "Entrada Mbps", "tx_mbps": "Salida Mbps",
           "capacity_mbps": "Capacidad", "latency_ms": "Latencia (ms)", "packet_loss_pct": "Pérdida %",
           "availability_pct": "Disponibilidad"}
MANUAL = {"Pérdida %": "packet_loss_pct"}


def links(spark, sf):
    return I.derive_utilization(fx.history(spark, sf))


def checked(spark, sf):
    return I.validate_rows(fx.history_raw(spark, sf))


@query("map_columns")
def _(spark, sf):
    return I.map_columns(fx.history(spark, sf).withColumnsRenamed(SPANISH), MANUAL)


query("validate_rows")(checked)
query("rejected_rows")(lambda s, d: I.rejected_rows(checked(s, d)))
query("accepted_rows")(lambda s, d: I.accepted_rows(checked(s, d)))
query("derive_utilization")(lambda s, d: I.derive_utilization(I.accepted_rows(checked(s, d))))
query("ingest_warnings")(lambda s, d: I.ingest_warnings(checked(s, d)))
query("daily_link")(lambda s, d: H.daily_link(links(s, d)))
query("hourly_link")(lambda s, d: H.hourly_link(links(s, d)))
query("peak_hour")(lambda s, d: H.peak_hour(H.hourly_link(links(s, d))))
query("tail_mean")(lambda s, d: H.tail_mean(H.daily_link(links(s, d))))
query("link_trend")(lambda s, d: H.link_trend(H.daily_link(links(s, d))))
query("load_spearman")(lambda s, d: H.load_spearman(links(s, d)))
query("load_delta")(lambda s, d: H.load_delta(links(s, d)))
query("link_summary")(lambda s, d: H.link_summary(links(s, d)))
query("link_alerts")(lambda s, d: H.link_alerts(H.link_core(links(s, d))))
query("ranked_links")(lambda s, d: H.ranked_links(H.link_summary(links(s, d))))
query("ranked_alerts")(lambda s, d: H.ranked_alerts(H.link_alerts(H.link_core(links(s, d)))))
query("status_counts")(lambda s, d: H.status_counts(H.link_summary(links(s, d))))
query("capacity_ladder")(lambda s, d: H.capacity_plan(H.link_core(links(s, d))))
query("systematic_sample")(lambda s, d: H.systematic_sample(links(s, d)))
query("link_audit")(lambda s, d: H.link_audit(links(s, d)))
query("link_audit_meta")(lambda s, d: H.link_audit_meta(links(s, d)))


@query("average_rank", digits=9)
def _(spark, sf):
    ranked = ranks.average_ranks(links(spark, sf), ["link_id"], "utilization")
    return ranked.select("link_id", "utilization", F.round("avg_rank", 6).alias("avg_rank"), "tie_count")


@query("trend_line")
def _(spark, sf):
    daily = H.daily_link(links(spark, sf))
    return H.trend_line(daily, H.link_trend(daily))


# --- run audit: quality and events -------------------------------------------

THRESHOLDS = EventThresholds(bucket_seconds=fx.BUCKET_SECONDS, merge_gap_seconds=fx.MERGE_GAP_SECONDS)


def counters(spark, sf):
    """The counter view sums over a whole run and is read twice by every step to the sample before: it is written once."""
    return stage(fx.iface(spark, sf), "counters")


def interface(spark, sf):
    rows, runs = together(lambda: counters(spark, sf), lambda: stage(fx.runs(spark, sf), "runs"))
    return Q.processed_interface(rows, runs, fx.COUNTER_MAX)


def probes(spark, sf):
    return Q.processed_probes(fx.probes(spark, sf))


def stages(spark, sf):
    return E.EventStages(interface(spark, sf), probes(spark, sf), THRESHOLDS)


def joined(df, *columns):
    """Arrays as ``|``-joined text."""
    return df.withColumns({c: F.array_join(c, "|") for c in columns or ("metrics_changed",)})


@query("counter_delta")
def _(spark, sf):
    return C.counter_delta(fx.iface(spark, sf), fx.COUNTER_MAX).select(
        "row_no", "run_id", "interface", "timestamp", "rx_bytes_delta", "tx_bytes_delta", "rx_drops_delta",
        "rx_errors_delta", "counter_event", "elapsed_seconds")


query("elapsed_valid")(lambda s, d: C.elapsed_valid(fx.iface(s, d)).select("row_no", "run_id", "timestamp", "elapsed_seconds"))
query("delay_variation")(lambda s, d: C.delay_variation(fx.probes(s, d)).select("row_no", "run_id", "target", "delay_variation_ms"))
query("reachability_transitions")(lambda s, d: C.reachability_transitions(fx.probes(s, d)))
query("error_transitions")(lambda s, d: C.error_transitions(fx.iface(s, d), ["run_id", "interface"]))
query("interface_summary")(lambda s, d: Q.interface_summary(interface(s, d)))
query("probe_summary")(lambda s, d: Q.probe_summary(probes(s, d)))
query("source_overlap")(lambda s, d: Q.source_overlap(fx.iface(s, d), fx.probes(s, d)))


@query("parse_probe_logs")
def _(spark, sf):
    return C.parse_probe_logs(fx.probe_logs(spark, sf)).select(
        "row_no", "run_id", "target", "packets_sent", "packets_received", "rtt_ms", "rtt_min_ms", "rtt_max_ms",
        "packet_loss_pct", "reachability", "estimated_outbound_payload_bytes")


@query("processed_interface")
def _(spark, sf):
    return interface(spark, sf).select(
        "row_no", "run_id", "interface", "timestamp", "sample_ok", "rx_bytes_delta", "tx_bytes_delta",
        "rx_drops_delta", "rx_errors_delta", "counter_event", "elapsed_seconds", "rx_rate_mbps", "tx_rate_mbps",
        "rx_utilization_pct", "tx_utilization_pct", "utilization_pct", "capacity_mbps")


@query("processed_probes")
def _(spark, sf):
    return probes(spark, sf).select("row_no", "run_id", "target", "timestamp", "packets_sent", "packets_received",
                                    "reachability_bool", "rtt_ms", "delay_variation_ms")


@query("overlap_filter")
def _(spark, sf):
    iface, probe = fx.iface(spark, sf), fx.probes(spark, sf)
    overlap = Q.source_overlap(iface, probe, strict=True)
    keep = ["run_id", "row_no", "timestamp"]
    return (E.clip(iface, overlap).select(F.lit("interface").alias("source"), *keep)
            .unionByName(E.clip(probe, overlap).select(F.lit("probes").alias("source"), *keep)))


@query("sample_loss_pct")
def _(spark, sf):
    iface, probe = fx.iface(spark, sf), fx.probes(spark, sf)
    return E.clip(probe, Q.source_overlap(iface, probe, strict=True)).select(
        "run_id", "row_no", "target", loss_pct(F.col("packets_sent"), F.col("packets_received")).alias("sample_loss_pct"))


query("event_iface_buckets")(lambda s, d: stages(s, d).iface_buckets)
query("event_probe_buckets")(lambda s, d: stages(s, d).probe_buckets)
query("metric_flags")(lambda s, d: joined(E.metric_flags(stages(s, d).signals)))
query("event_timeline")(lambda s, d: joined(stages(s, d).timeline))
query("sessionize_events")(lambda s, d: stages(s, d).buckets.select("run_id", "timestamp", "event_no", "event_id"))
query("events_rollup")(lambda s, d: joined(stages(s, d).events).drop("event_no", "bucket_seconds"))
query("event_evidence")(lambda s, d: stages(s, d).evidence.drop("event_no", "reachability"))
query("event_targets")(lambda s, d: stages(s, d).targets)


@query("baselines")
def _(spark, sf):
    st = stages(spark, sf)
    return E.baselines(st.iface_base, st.probe_base)


@query("event_metadata")
def _(spark, sf):
    st = stages(spark, sf)
    return E.event_metadata(st.timeline, st.buckets, st.overlap)


# --- run audit: correlations, evidence, fingerprints --------------------------

CORRELATION = CorrelationConfig(bucket_seconds=fx.BUCKET_SECONDS)


def relations(spark, sf, st=None):
    st = st or stages(spark, sf)
    st.load()
    return K.CorrelationStages(st.interface, st.probes, fx.host(spark, sf), CORRELATION)


def linked_stages(spark, sf):
    """Events and correlations of the same samples, computed side by side."""
    st = stages(spark, sf)
    linked = relations(spark, sf, st)
    together(lambda: st.events, lambda: st.targets, lambda: linked.correlations)
    return st, linked


def references(spark, sf):
    st, linked = linked_stages(spark, sf)
    refs = V.event_correlations(st.events, st.targets, linked.correlations)
    return st, stage(V.top_correlations(refs), "references")


def trace(spark, sf):
    st = stages(spark, sf)
    return st, stage(P.fingerprint_trace(P.loss_baseline(st.evidence, st.probe_base)), "trace")


query("corr_iface_buckets")(lambda s, d: K.corr_iface_buckets(interface(s, d), CORRELATION))
query("corr_probe_buckets")(lambda s, d: K.corr_probe_buckets(probes(s, d), CORRELATION))
query("corr_host_buckets")(lambda s, d: K.corr_host_buckets(fx.host(s, d), CORRELATION))
query("align_network")(lambda s, d: relations(s, d).network)
query("align_host")(lambda s, d: relations(s, d).host_aligned)
query("aligned_pairs")(lambda s, d: relations(s, d).aligned)
query("correlations")(lambda s, d: relations(s, d).correlations)


@query("event_correlations")
def _(spark, sf):
    st, linked = linked_stages(spark, sf)
    return V.event_correlations(st.events, st.targets, linked.correlations).select(
        "run_id", "event_id", "supports", "relation_id", "kind", "target", "spearman_rho")


query("top_correlations")(lambda s, d: references(s, d)[1].select(
    "run_id", "event_id", "supports", "relation_id", "kind", "target", "spearman_rho", "ref_no"))


@query("findings")
def _(spark, sf):
    st, refs = references(spark, sf)
    return joined(V.findings(st.events, st.targets, refs), "metrics_changed", "targets", "limitations").drop("bucket_seconds")


@query("core_metric_overlap")
def _(spark, sf):
    events = stages(spark, sf).events
    metrics = F.col("metrics_changed")
    return events.select("run_id", "event_id", V.has_any(metrics, *V.QUALITY_METRICS).alias("quality"),
                         V.has_any(metrics, "drops", "errors").alias("interface"),
                         V.has_any(metrics, "rtt", "packet_loss").alias("sensor"))


@query("evidence_trace")
def _(spark, sf):
    st, refs = references(spark, sf)
    return V.evidence_trace(V.findings(st.events, st.targets, refs), refs)


query("fingerprint_trace")(lambda s, d: trace(s, d)[1])
query("fingerprint_extremes", digits=3)(lambda s, d: P.fingerprint_extremes(trace(s, d)[1]))


@query("fingerprints", digits=3)
def _(spark, sf):
    st, rows = trace(spark, sf)
    return joined(P.fingerprints(st.events, st.targets, rows), "metrics_changed", "targets", "limitations").drop(
        "fingerprint_sha256")


@query("fingerprint_hash")
def _(spark, sf):
    st, rows = trace(spark, sf)
    return P.fingerprints(st.events, st.targets, rows).select("run_id", "fingerprint_id", "fingerprint_sha256")


# --- data quality gate ---------------------------------------------------------

def raw_samples(spark, sf):
    return N.samples_long(fx.damaged(fx.iface(spark, sf)), fx.damaged(fx.host(spark, sf)), fx.damaged(fx.probes(spark, sf)))


def counted(spark, sf):
    return C.counter_delta(fx.iface(spark, sf), fx.COUNTER_MAX)


def gate(spark, sf):
    return N.QualityStages(stage(counted(spark, sf), "counted"), fx.host(spark, sf), fx.probes(spark, sf), fx.runs(spark, sf))


query("expected_samples")(lambda s, d: N.expected_samples(fx.runs(s, d)))
query("experiment_estimate")(lambda s, d: N.experiment_estimate(fx.runs(s, d)))
query("scan_raw_samples")(lambda s, d: raw_samples(s, d))
query("out_of_order")(lambda s, d: N.out_of_order(raw_samples(s, d)))
query("gaps")(lambda s, d: N.gaps(raw_samples(s, d), fx.runs(s, d)))
query("duplicate_samples")(lambda s, d: N.duplicate_samples(raw_samples(s, d)))
query("timestamp_profile")(lambda s, d: N.timestamp_profile(stage(raw_samples(s, d)), fx.runs(s, d)))
query("source_profile")(lambda s, d: N.source_profile(stage(raw_samples(s, d)), fx.runs(s, d)))
query("impossible_values")(lambda s, d: N.impossible_values(counted(s, d), fx.host(s, d), fx.probes(s, d)))
query("counter_events")(lambda s, d: N.counter_events(counted(s, d)))
query("interface_match")(lambda s, d: N.interface_match(fx.iface(s, d), fx.runs(s, d)))
query("collector_health")(lambda s, d: N.collector_health(raw_samples(s, d)))
query("quality_checks")(lambda s, d: gate(s, d).checks)
query("quality_gate")(lambda s, d: gate(s, d).gate)


# --- integrity -----------------------------------------------------------------

def entries(spark, sf):
    return G.parse_manifest(fx.manifests(spark, sf))


query("file_hashes")(lambda s, d: G.file_hashes(fx.files(s, d)))
query("scan_checksum_manifest")(lambda s, d: entries(s, d))
query("untracked_files")(lambda s, d: G.untracked_files(entries(s, d), G.file_hashes(fx.files(s, d))))
query("verify_manifest")(lambda s, d: G.verify_manifest(entries(s, d), G.file_hashes(fx.files(s, d))))
query("integrity_summary")(lambda s, d: G.integrity_summary(G.verify_manifest(entries(s, d), G.file_hashes(fx.files(s, d))), True))


def difference(spark, sf):
    return G.table_diff(*fx.order_tables(spark, sf), ["o_orderkey"], "orders").drop("left", "right")


query("table_diff")(difference)
query("diff_limit")(lambda s, d: G.diff_limit(difference(s, d), ["o_orderkey", "column"]))


@query("cell_type")
def _(spark, sf):
    cells = fx.ev(spark, sf).select("event_id", F.when(F.col("k") % 5 == 0, F.lit(" ")).when(F.col("k") % 5 == 1, F.lit("TRUE"))
                                    .when(F.col("k") % 5 == 2, F.col("k").cast("string")).when(F.col("k") % 5 == 3, F.lit("1.5e3"))
                                    .otherwise(F.col("event_type")).alias("cell"))
    return cells.select("event_id", G.cell_type(F.col("cell")).alias("cell_type"))


SUMMARY_KEYS = {"interface_summary": ["run_id", "interface"], "probe_summary": ["run_id", "target"], "events": ["run_id", "event_id"],
                "correlations": ["run_id", "relation_id"], "findings": ["run_id", "finding_id"], "fingerprints": ["run_id", "event_id"]}


def replay(spark, sf, parts):
    """The six summary tables of a run, written and read back; the samples come in ``parts`` shuffled pieces."""
    rows, runs = together(lambda: stage(fx.iface(spark, sf).repartition(parts), "counters"), lambda: stage(fx.runs(spark, sf), "runs"))
    iface = Q.processed_interface(rows, runs, fx.COUNTER_MAX)
    st = E.EventStages(iface, Q.processed_probes(fx.probes(spark, sf).repartition(parts)), THRESHOLDS)
    st.load()
    linked = K.CorrelationStages(st.interface, st.probes, fx.host(spark, sf).repartition(parts), CORRELATION)
    tables = {"interface_summary": lambda: Q.interface_summary(st.interface), "probe_summary": lambda: Q.probe_summary(st.probes)}
    *first, _, _ = together(*[lambda n=name, t=table: stage(t(), n) for name, table in tables.items()],
                            lambda: st.events, lambda: linked.correlations)

    def found():
        refs = stage(V.top_correlations(V.event_correlations(st.events, st.targets, linked.correlations)), "references")
        return stage(V.findings(st.events, st.targets, refs), "findings")

    def vectors():
        lines = stage(P.fingerprint_trace(P.loss_baseline(st.evidence, st.probe_base)), "trace")
        return stage(P.fingerprints(st.events, st.targets, lines), "fingerprints")

    findings, fingerprints = together(found, vectors)
    return {**dict(zip(tables, first)), "events": st.events, "correlations": linked.correlations, "findings": findings, "fingerprints": fingerprints}


@query("reproducibility")
def _(spark, sf):
    """Two whole runs, the second from input dealt otherwise, and one table with a seeded drift that must be found."""
    first, second = together(lambda: replay(spark, sf, 3), lambda: replay(spark, sf, 7))
    odd = F.pmod(F.substring("run_id", 5, 9).cast("int"), F.lit(2)) == 1
    first["drifted"] = first["probe_summary"]
    second["drifted"] = second["probe_summary"].withColumn("samples", F.col("samples") + F.when(odd, 1).otherwise(0))
    return G.check_reproducibility(first, second, {**SUMMARY_KEYS, "drifted": SUMMARY_KEYS["probe_summary"]})


def sample_files(spark, sf):
    parts = [fx.iface(spark, sf).withColumn("file", F.lit("interface_samples")),
             fx.host(spark, sf).withColumn("file", F.lit("host_samples")).drop("sample_status"),
             fx.probes(spark, sf).withColumn("file", F.lit("probe_samples"))]
    profiles = [G.file_profile(p) for p in parts]
    return profiles[0].unionByName(profiles[1]).unionByName(profiles[2])


query("file_profile")(lambda s, d: joined(sample_files(s, d), "interfaces", "targets"))


def configured(spark, sf):
    return fx.runs(spark, sf).select("run_id", F.array(F.lit(" t1"), F.lit("ref "), F.lit("")).alias("configured_targets"))


query("run_metadata")(lambda s, d: joined(G.run_metadata(sample_files(s, d), configured(s, d)), "discovered_interfaces", "targets"))
query("known_targets")(lambda s, d: joined(G.run_metadata(sample_files(s, d), configured(s, d)).select("run_id", "targets"), "targets"))


# --- report --------------------------------------------------------------------

def audit(spark, sf):
    interface, probes, host = together(lambda: counters(spark, sf), lambda: stage(fx.probes(spark, sf), "probe_view"),
                                       lambda: stage(fx.host(spark, sf), "host_view"))
    return RunAudit(interface, probes, host, fx.runs(spark, sf),
                    counter_maxima=fx.COUNTER_MAX, thresholds=THRESHOLDS, correlation=CORRELATION)


query("headline_metrics")(lambda s, d: audit(s, d).headline)
query("dedupe_limitations")(lambda s, d: joined(R.dedupe_limitations(gate(s, d).gate), "limitations"))
query("chart_series")(lambda s, d: R.chart_series(interface(s, d), probes(s, d), fx.host(s, d)))
query("chart_windows")(lambda s, d: R.chart_windows(R.chart_series(interface(s, d), probes(s, d), fx.host(s, d))))
query("run_report")(lambda s, d: audit(s, d).report.select(
    "run_id", "section", "item_no", (F.get_json_object("payload", "$").isNotNull()).alias("valid_payload"),
    F.length("payload_sha256").alias("digest_length")))
query("analysis_manifest")(lambda s, d: R.analysis_manifest(stage(audit(s, d).report, "report")).drop("report_sha256"))


@query("findings_events")
def _(spark, sf):
    done = audit(spark, sf)
    return R.findings_events(done.findings, done.stages.events)


@query("findings_fingerprints", digits=3)
def _(spark, sf):
    done = audit(spark, sf)
    together(lambda: done.findings, lambda: done.fingerprints)
    return R.findings_fingerprints(done.findings, done.fingerprints)


query("executive_summary")(lambda s, d: audit(s, d).summary)


@query("pseudonymize_hosts")
def _(spark, sf):
    return S.pseudonymize_hosts(fx.probes(spark, sf).select("run_id", "row_no", F.col("target").alias("hostname"), "address"),
                                address="address")


# --- sources and sinks: written to the shared folder and read back ----------------

@query("scan_history")
def _(spark, sf):
    path = scratch_dir(spark, "history")
    W.write_table(fx.history(spark, sf).withColumnsRenamed(SPANISH), path, "csv")
    return I.typed(S.read_history(spark, path, MANUAL))


@query("scan_samples")
def _(spark, sf):
    path = scratch_dir(spark, "probes")
    W.write_table(fx.probes(spark, sf), path, "csv")
    rows = S.read_samples(spark.read.csv(path, header=True), ("timestamp", "target", "packets_sent", "packets_received", "rtt_ms"))
    return rows.select(F.col("row_no").cast("long").alias("row_no"), "run_id", "target", "timestamp",
                       F.col("packets_sent").cast("long").alias("packets_sent"),
                       F.col("packets_received").cast("long").alias("packets_received"),
                       F.col("rtt_ms").cast("double").alias("rtt_ms"))


def config_path(spark, sf):
    return W.write_table(fx.run_configs(spark, sf), scratch_dir(spark, "configs"), "json")


query("runs_dim")(lambda s, d: joined(S.read_run_configs(s, config_path(s, d)), "configured_targets"))
query("run_targets")(lambda s, d: S.run_targets(s, config_path(s, d)))


@query("scan_events_json")
def _(spark, sf):
    st = stages(spark, sf)
    path = W.write_table(W.event_documents(st.events, st.evidence), scratch_dir(spark, "events"), "json")
    return S.read_events(spark, path)[1].drop("reachability")


@query("invalid_events")
def _(spark, sf):
    """Event documents with missing fields, negative durations and repeated ids, written and read back."""
    st = stages(spark, sf)
    n = F.substring("event_id", 7, 9).cast("int")
    broken = st.events.withColumns({"severity": F.when(n % 3 != 0, F.col("severity")),
                                    "duration_seconds": F.when(n % 5 == 0, F.lit(-1.0)).otherwise(F.col("duration_seconds"))})
    headers = broken.unionByName(broken.where(n % 4 == 0)).select(
        "run_id", "event_id", "start", "end", "duration_seconds", "metrics_changed", "severity", "confidence", F.lit(0).cast("long").alias("part_no"),
        F.struct("bucket_seconds", "anomalous_buckets").alias("evidence"))
    path = W.write_table(headers, scratch_dir(spark, "broken-events"), "json")
    return joined(S.invalid_events(S.read_events(spark, path)[0]).select("run_id", "event_id", "problems"), "problems")


@query("scan_correlations_json")
def _(spark, sf):
    path = W.write_table(relations(spark, sf).correlations, scratch_dir(spark, "correlations"), "json")
    return S.read_correlations(spark, path)


def odd_run_files(spark, sf):
    """The documents as files: every fifth hidden, every seventh in a hidden folder, every eleventh empty."""
    n = F.col("doc_id")
    name = F.concat(F.when(n % 5 == 0, ".").otherwise(""), F.lit("doc "), n.cast("string"), F.lit(".txt"))
    folder = F.when(n % 7 == 0, "_staging/.old/").when(n % 3 == 0, "docs/").otherwise("")
    return fx.files(spark, sf).select("run_id", F.concat(folder, name).alias("path"), F.when(n % 11 == 0, "").otherwise(F.col("content")).alias("content"))


@query("scan_files_sha256")
def _(spark, sf):
    root = scratch_dir(spark, "files")
    X.write_run_files(odd_run_files(spark, sf), root).count()
    return G.file_hashes(X.read_run_hashes(spark, root))


def sizes(spark, paths):
    """Row count of every written table, read back from disk."""
    rows = None
    for name, path in paths.items():
        fmt = "json" if name in JSON_TABLES else "text" if name == "checksums" else "parquet"
        part = spark.read.format(fmt).load(path).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = part if rows is None else rows.unionByName(part)
    return rows


JSON_TABLES = {"diagnosis", "manifest", "windows", "events", "correlations", "findings", "fingerprints", "gate", "metadata", "report"}


@query("write_history")
def _(spark, sf):
    df = links(spark, sf)
    core = stage(H.link_core(df), "core")
    return sizes(spark, W.write_history(scratch_dir(spark, "out"), H.summarize(core), H.link_alerts(core), H.daily_link(df),
                                        H.hourly_link(df), df, I.rejected_rows(checked(spark, sf))))


@query("write_link_audit")
def _(spark, sf):
    df = links(spark, sf)
    return sizes(spark, W.write_link_audit(scratch_dir(spark, "out"), H.link_audit(df), df, H.link_audit_meta(df)))


@query("write_quality")
def _(spark, sf):
    st = stages(spark, sf)
    return sizes(spark, W.write_quality(scratch_dir(spark, "out"), Q.interface_summary(st.interface), Q.probe_summary(st.probes),
                                        st.interface, st.probes, Q.source_overlap(st.interface, st.probes)))


@query("write_events")
def _(spark, sf):
    st = stages(spark, sf)
    return sizes(spark, W.write_events(scratch_dir(spark, "out"), st.events, st.evidence, st.timeline))


@query("write_correlations")
def _(spark, sf):
    found = relations(spark, sf)
    return sizes(spark, W.write_correlations(scratch_dir(spark, "out"), found.correlations, found.aligned))


@query("write_evidence")
def _(spark, sf):
    st, refs = references(spark, sf)
    found = stage(V.findings(st.events, st.targets, refs), "findings")
    return sizes(spark, W.write_evidence(scratch_dir(spark, "out"), found, V.evidence_trace(found, refs)))


@query("write_fingerprints")
def _(spark, sf):
    st, rows = trace(spark, sf)
    return sizes(spark, W.write_fingerprints(scratch_dir(spark, "out"), P.fingerprints(st.events, st.targets, rows), rows))


@query("write_dataset_quality")
def _(spark, sf):
    g = gate(spark, sf)
    return sizes(spark, W.write_dataset_quality(scratch_dir(spark, "out"), g.gate, g.profile, g.checks))


@query("write_checksums")
def _(spark, sf):
    lines = G.manifest_lines(G.file_hashes(fx.files(spark, sf)))
    return sizes(spark, W.write_checksums(scratch_dir(spark, "out"), G.run_metadata(sample_files(spark, sf)), lines))


@query("write_report_tables")
def _(spark, sf):
    report = stage(audit(spark, sf).report, "report")
    return sizes(spark, W.write_report_tables(scratch_dir(spark, "out"), report, R.analysis_manifest(report)))


# The same sinks by their cells: what was written, read back and compared with the statement of its source.

@query("read_back_history")
def _(spark, sf):
    df = links(spark, sf)
    core = stage(H.link_core(df), "core")
    return spark.read.parquet(W.write_history(scratch_dir(spark, "out"), H.summarize(core), H.link_alerts(core), H.daily_link(df), H.hourly_link(df), df,
                                              I.rejected_rows(checked(spark, sf)))["summary"])


@query("read_back_processed")
def _(spark, sf):
    path = W.write_link_audit(scratch_dir(spark, "out"), H.link_audit(links(spark, sf)), links(spark, sf), H.link_audit_meta(links(spark, sf)))["processed"]
    return spark.read.parquet(path).select("row_no", "link_id", "timestamp", "rx_utilization", "tx_utilization", "utilization", "hour")


@query("read_back_quality")
def _(spark, sf):
    st = stages(spark, sf)
    return spark.read.parquet(W.write_quality(scratch_dir(spark, "out"), Q.interface_summary(st.interface), Q.probe_summary(st.probes), st.interface,
                                              st.probes, Q.source_overlap(st.interface, st.probes))["probe_summary"])


@query("read_back_events")
def _(spark, sf):
    st = stages(spark, sf)
    return spark.read.parquet(W.write_events(scratch_dir(spark, "out"), st.events, st.evidence, st.timeline)["summary"]).drop("event_no", "bucket_seconds")


@query("read_back_correlations")
def _(spark, sf):
    found = relations(spark, sf)
    return spark.read.parquet(W.write_correlations(scratch_dir(spark, "out"), found.correlations, found.aligned)["summary"])


@query("read_back_evidence")
def _(spark, sf):
    st, refs = references(spark, sf)
    found = stage(V.findings(st.events, st.targets, refs), "findings")
    return spark.read.parquet(W.write_evidence(scratch_dir(spark, "out"), found, V.evidence_trace(found, refs))["summary"]).drop("bucket_seconds")


# --- streams: the whole table lands in two parts, the second run resumes the first --

def opened(df):
    return df.where(F.col("run_id") != fx.CLOSING["run_id"])


@query("stream_ingest")
def _(spark, sf):
    return T.land_and_run(fx.in_slices(fx.probes(spark, sf)), lambda s: Q.processed_probes(
        s.withColumn("delay_variation_ms", F.lit(None).cast("double")))).select(
        "run_id", "target", "row_no", "timestamp", "packets_sent", "packets_received", "reachability_bool", "rtt_ms")


query("stream_counter_delta")(lambda s, d: T.land_and_run(
    fx.in_slices(fx.iface(s, d)), lambda x: U.stream_counter_delta(x, fx.COUNTER_MAX)))
query("stream_delay_variation")(lambda s, d: T.land_and_run(fx.in_slices(fx.probes(s, d)), U.stream_delay_variation).select(
    "row_no", "run_id", "target", "delay_variation_ms"))
query("stream_transitions")(lambda s, d: T.land_and_run(fx.in_slices(fx.probes(s, d)), U.stream_transitions))


@query("stream_buckets")
def _(spark, sf):
    slices = fx.in_slices(stage(interface(spark, sf), "interface"), fx.CLOSING)
    return opened(T.land_and_run(slices, lambda s: T.stream_iface_buckets(s, THRESHOLDS)))


@query("stream_probe_buckets")
def _(spark, sf):
    slices = fx.in_slices(stage(probes(spark, sf), "probes"), fx.CLOSING)
    return opened(T.land_and_run(slices, lambda s: T.stream_probe_buckets(s, THRESHOLDS)))


@query("stream_events")
def _(spark, sf):
    st = stages(spark, sf)
    slices = fx.in_slices(T.combined_samples(st.interface, st.probes), fx.CLOSING)
    closing = {"run_id": fx.CLOSING["run_id"], "overlap_exists": True, "overlap_start": "2024-01-01 00:00:00", "overlap_end": "2024-04-01 00:00:00"}
    window = st.overlap.unionByName(spark.range(1).select(*[F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in st.overlap.schema]))
    return opened(T.land_and_run(slices, lambda s: T.stream_events(s, st.iface_base, st.probe_base, window, THRESHOLDS)))


@query("stream_dedup")
def _(spark, sf):
    typed = I.typed(fx.history_raw(spark, sf)).where(F.col("timestamp").isNotNull()).select("timestamp", "link_id", F.lit(1).alias("landing"))
    # the early half lands again with everything: its first copies stay
    landings = [fx.in_slices(typed)[0], typed.withColumn("landing", F.lit(2))]
    return T.land_and_run(landings, lambda s: T.stream_dedup(s, "60 days"))


@query("stream_dropped_rows")
def _(spark, sf):
    early, late = (piece.repartition(8) for piece in fx.in_slices(fx.host(spark, sf).select("run_id", "timestamp", F.col("run_id").alias("link_id"))))
    return T.land_and_count([late, early], T.stream_dedup).groupBy("landing").agg(
        F.sum("input_rows").alias("input_rows"), F.sum("dropped_by_watermark").alias("dropped_by_watermark"))


@query("stream_late_rows")
def _(spark, sf):
    runs = fx.runs(spark, sf).withColumn("started", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    return T.land_and_run(fx.in_slices(fx.host(spark, sf)), lambda s: T.stream_late_rows(s, runs)).select(
        "run_id", "row_no", "timestamp")
