"""Run-level report: headline figures, summary text, and the report as rows.

A report is a table ``run_id, section, item_no, payload``: one row per run and
section item. No array grows with the number of events of a run; a reader of
one run filters on ``run_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.config import ReportConfig
from linklens.functions.scalars import shown
from linklens.operators.events import _both

SCHEMA_VERSION = "link-health-audit-v1"  # fixed value
PROBE_HEADLINES = ("availability_observed_pct", "rtt_median_ms", "rtt_p95_ms", "rtt_p99_ms", "loss_percent",
                   "delay_variation_p95_ms")
INTERFACE_HEADLINES = ("utilization_mean_pct", "utilization_p95_pct", "utilization_max_pct", "rx_drops_delta_total",
                       "tx_drops_delta_total")


def findings_events(findings: DataFrame, events: DataFrame) -> DataFrame:
    own = events.select("run_id", "event_id", F.col("severity").alias("event_severity"),
                        F.col("confidence").alias("event_confidence"), F.col("max_metrics").alias("event_max_metrics"))
    return findings.select("run_id", "finding_id", "event_id", "confidence").join(own, ["run_id", "event_id"], "left")


def findings_fingerprints(findings: DataFrame, fingerprints: DataFrame) -> DataFrame:
    vector = fingerprints.select("run_id", "event_id", "fingerprint_id", "delta_utilization_pp", "delta_rtt_pct",
                                 "delta_delay_variation_pct", "delta_loss_pp", "delta_drops", "core_completeness_pct")
    return findings.select("run_id", "finding_id", "event_id").join(vector, ["run_id", "event_id"], "left")


def headline_metrics(runs: DataFrame, interfaces: DataFrame, targets: DataFrame, events: DataFrame) -> DataFrame:
    """One row per run: the first interface, the primary target (else the first by name), the event count."""
    named = runs.select("run_id", "primary_target")
    first = interfaces.groupBy("run_id").agg(*[F.min_by(c, "interface").alias(c) for c in INTERFACE_HEADLINES])
    choice = F.struct((F.coalesce(F.col("target") != F.col("primary_target"), F.lit(True))).cast("int"), F.col("target"))
    chosen = targets.join(named, "run_id").groupBy("run_id").agg(
        F.min_by("target", choice).alias("headline_target"), *[F.min_by(c, choice).alias(c) for c in PROBE_HEADLINES])
    counted = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("event_count"))
    return (named.join(first, "run_id", "left").join(chosen, "run_id", "left").join(counted, "run_id", "left")
            .fillna(0, ["event_count"]))


def chart_series(interface: DataFrame, probes: DataFrame, host: DataFrame) -> DataFrame:
    """Long form of the six charts: ``run_id, chart, series, timestamp, value``; nulls dropped."""
    def unfold(df: DataFrame, charts: list[tuple[str, Column, Column]]) -> DataFrame:
        points = F.array(*[F.struct(F.lit(chart).alias("chart"), series.alias("series"), value.cast("double").alias("value"))
                           for chart, series, value in charts])
        return df.select("run_id", "timestamp", F.explode(points).alias("p")).select("run_id", "timestamp", "p.*")

    loss = F.col("packet_loss_pct") if "packet_loss_pct" in probes.columns else F.lit(None)
    parts = [
        unfold(interface, [("utilization", F.lit("utilization"), F.col("utilization_pct")),
                           ("drops", F.lit("drops"), _both("rx_drops_delta", "tx_drops_delta"))]),
        unfold(probes, [("rtt", F.col("target"), F.col("rtt_ms")), ("delay", F.col("target"), F.col("delay_variation_ms")),
                        ("loss", F.col("target"), loss)]),
        unfold(host, [("cpu", F.lit("CPU"), F.col("cpu_percent"))])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(
        F.col("value").isNotNull() & F.col("timestamp").isNotNull())


def chart_windows(series: DataFrame) -> DataFrame:
    return series.groupBy("run_id").agg(F.min("timestamp").alias("global_start"), F.max("timestamp").alias("global_end"))


def _hours(seconds: Column) -> Column:
    return (F.when(seconds >= 3600, F.concat(shown(seconds / 3600, 2), F.lit(" horas")))
            .when(seconds.isNotNull(), F.concat(shown(seconds, 1), F.lit(" segundos"))).otherwise("una ventana observada"))


def executive_summary(runs: DataFrame, gate: DataFrame, headline: DataFrame, findings: DataFrame,
                      cfg: ReportConfig = ReportConfig()) -> DataFrame:
    """One templated summary per run; blocked runs say so and cite no findings."""
    cfg.validate()
    found = findings.groupBy("run_id").agg(F.count(F.lit(1)).alias("finding_count"),
                                           F.min_by("finding_id", F.struct("start", "finding_id")).alias("top_finding"),
                                           F.min_by("fact", F.struct("start", "finding_id")).alias("top_fact"))
    rows = (gate.join(runs.select("run_id", "duration_seconds"), "run_id")
            .join(headline.select("run_id", "event_count"), "run_id", "left").join(found, "run_id", "left")
            .fillna(0, ["event_count", "finding_count"]))
    safe, some = F.col("safe_for_conclusions"), F.col("finding_count") > 0
    text = lambda c: F.col(c).cast("string")
    base = F.concat(F.lit(f"Auditoría de {cfg.link_name} para {cfg.company}: "), _hours(F.col("duration_seconds")),
                    F.lit("; "), text("valid_rows_total"), F.lit(" de "), text("expected_rows_total"),
                    F.lit(" filas, integridad "), shown(F.col("temporal_integrity_pct"), 2), F.lit("%. "))
    tail = (F.when(~safe, "La calidad del dataset no habilita conclusiones.")
            .when(some, F.concat(text("event_count"), F.lit(" eventos y "), text("finding_count"), F.lit(" hallazgos.")))
            .otherwise(F.concat(text("event_count"), F.lit(" eventos, sin hallazgos."))))
    key = (F.when(~safe, "Análisis bloqueado hasta corregir la evidencia.")
           .when(some, F.concat(F.lit("Hallazgo principal "), F.col("top_finding"), F.lit(": "), F.col("top_fact")))
           .otherwise("La ausencia de hallazgos no demuestra ausencia de degradación."))
    return rows.select("run_id", F.when(safe, "good").otherwise("note").alias("class"),
                       F.concat(base, tail).alias("summary"), key.alias("key_message"))


# Fixed order of report limitations; later stages add theirs.
LIMITATIONS = {
    "report": ("Describe únicamente el periodo observado.", "La disponibilidad observada no es un SLA.",
               "Correlación y coincidencia no demuestran causalidad.", "Lo no disponible se presenta como N/D."),
    "gate": ("La calidad describe únicamente esta ejecución.", "Un target no alcanzable no identifica la causa."),
    "analysis": ("Describe únicamente el periodo observado.", "Spearman mide asociación monotónica.",
                 "Correlación y coincidencia no demuestran causalidad."),
}


def dedupe_limitations(gate: DataFrame) -> DataFrame:
    """Limitations per run in first-seen order, each text once; analysis texts only where it ran."""
    texts = {k: F.array(*[F.lit(t) for t in v]) for k, v in LIMITATIONS.items()}
    ran = F.when(F.col("safe_for_conclusions"), texts["analysis"]).otherwise(F.array().cast("array<string>"))
    merged = F.array_distinct(F.filter(F.transform(F.concat(texts["report"], texts["gate"], ran), lambda t: F.trim(t)), lambda t: t != ""))
    return gate.select("run_id", merged.alias("limitations"))


def safe_only(df: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows of runs whose gate allows conclusions."""
    return df.join(gate.where("safe_for_conclusions").select("run_id"), "run_id", "left_semi")


def run_report(runs: DataFrame, gate: DataFrame, checks: DataFrame, profile: DataFrame, headline: DataFrame,
               summary: DataFrame, events: DataFrame, findings: DataFrame, fingerprints: DataFrame,
               cfg: ReportConfig = ReportConfig()) -> DataFrame:
    """``run_id, section, item_no, payload``; analysis sections exist only for safe runs."""
    def section(df: DataFrame, name: str, number: Column) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "run_id"]), {"ignoreNullFields": "false"})
        return df.select("run_id", F.lit(name).alias("section"), number.cast("string").alias("item_no"), body.alias("payload"))

    head = runs.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "company": F.lit(cfg.company),
                             "link_name": F.lit(cfg.link_name), "strict_untracked": F.lit(cfg.strict_integrity)})
    none = F.lit("")
    parts = [
        section(head, "run", none), section(gate, "dataset_quality", none), section(summary, "executive_summary", none),
        section(dedupe_limitations(gate), "limitations", none), section(profile, "source", F.col("source")),
        section(checks, "check", F.col("check_id")), section(safe_only(headline, gate), "headline_metrics", none),
        section(safe_only(events, gate), "event", F.col("event_id")),
        section(safe_only(findings, gate), "finding", F.col("finding_id")),
        section(safe_only(fingerprints, gate), "fingerprint", F.col("fingerprint_id"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("payload_sha256", F.sha2("payload", 256))


def analysis_manifest(report: DataFrame) -> DataFrame:
    """One row per run: section sizes, whether the analysis ran, and the root of a hash tree over all payloads."""
    count = lambda name: F.count_if(F.col("section") == name)
    counts = report.groupBy("run_id").agg(
        count("event").alias("event_count"), count("finding").alias("finding_count"),
        count("fingerprint").alias("fingerprint_count"), count("check").alias("check_count"),
        (count("headline_metrics") > 0).alias("analysis_executed"))
    return counts.join(report_digest(report), "run_id").withColumn("causal_inference_performed", F.lit(False))


LEAF_DIGITS = 2


def report_digest(report: DataFrame) -> DataFrame:
    """``run_id, report_sha256``: leaves hash their items in order, the root hashes the leaves in order; every digest has its full 256 bits.

    An item falls on the leaf of the first hex digits of its address's hash, so a run's items are spread over ``16 ** LEAF_DIGITS`` leaves and
    only leaf digests meet in one group. A line names its address, so payloads that change places change the root.
    """
    address = F.concat_ws("\x1f", "section", "item_no")
    lines = report.select("run_id", F.substring(F.sha2(address, 256), 1, LEAF_DIGITS).alias("leaf"), F.concat_ws("\x1f", address, "payload_sha256").alias("line"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    leaves = lines.groupBy("run_id", "leaf").agg(joined("line").alias("digest"))
    return leaves.groupBy("run_id").agg(joined(F.concat_ws(":", "leaf", "digest")).alias("report_sha256"))
