"""Findings: events linked to the correlations that support or surround them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.config import EvidenceConfig
from linklens.functions.scalars import numbered, shown

# Correlated metric -> event metric.
EVENT_METRIC = {"rtt_ms": "rtt", "delay_variation_ms": "delay_variation", "packet_loss_pct": "packet_loss",
                "drops_delta": "drops"}
QUALITY_METRICS = ("rtt", "delay_variation", "packet_loss", "drops")
REFERENCE = ("relation_id", "kind", "target", "pair_count", "spearman_rho", "direction", "strength",
             "evidence_status", "first_timestamp", "last_timestamp", "note")


def has_any(metrics: Column, *names: str) -> Column:
    return F.arrays_overlap(metrics, F.array(*[F.lit(n) for n in names]))


def event_correlations(events: DataFrame, targets: DataFrame, correlations: DataFrame,
                       cfg: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """Correlations relevant to each event.

    Run, metric and target are equality keys: an event that names targets meets
    the correlations of these targets, and those that name none. An event without
    targets meets all correlations of its metric. What is left are predicates:
    closed time overlap and load or host kind.
    """
    named = targets.groupBy("run_id", "event_id").agg(F.count(F.lit(1)).alias("_targets"))
    by_metric = (events.select("run_id", "event_id", "start", "end",
                               F.array_contains("metrics_changed", "utilization").alias("_loaded"),
                               F.explode("metrics_changed").alias("event_metric"))
                 .join(named, ["run_id", "event_id"], "left"))
    mapped = F.coalesce(*[F.when(F.col("y_metric") == y, F.lit(m)) for y, m in EVENT_METRIC.items()])
    known = correlations.withColumn("event_metric", mapped).where(
        F.col("event_metric").isNotNull() & F.col("first_timestamp").isNotNull() & F.col("last_timestamp").isNotNull())
    kind = F.when((F.col("x_metric") == "utilization_pct") & F.col("_loaded"), "load_support").when(
        F.col("x_metric") == "cpu_percent", "host_context")
    keys = ["run_id", "event_metric"]
    named_known, free_known = known.where("target <> ''"), known.where("target IS NULL OR target = ''")
    by_target = by_metric.where("_targets IS NOT NULL").join(targets.select("run_id", "event_id", "target"), ["run_id", "event_id"])
    pairs = (by_target.join(named_known, keys + ["target"])
             .unionByName(by_metric.where("_targets IS NOT NULL").join(free_known, keys))
             .unionByName(by_metric.where("_targets IS NULL").join(known, keys))
             .where((F.col("last_timestamp") >= F.col("start")) & (F.col("first_timestamp") <= F.col("end")))
             .withColumn("kind", kind).where(F.col("kind").isNotNull()))
    supports = ((F.col("evidence_status") == "descriptive_association") & F.col("sufficient_samples")
                & (F.abs("spearman_rho") >= cfg.min_support_abs_rho))
    return (pairs.withColumn("supports", F.coalesce(supports, F.lit(False)))
            .select("run_id", "event_id", "supports", *REFERENCE))


def top_correlations(relevant: DataFrame, cfg: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """Best references per event and list; an event has at most five per target plus one."""
    load_first = F.when(F.col("supports") & (F.col("kind") == "load_support"), 0).otherwise(1)
    best = F.when(F.col("supports"), -F.abs("spearman_rho")).otherwise(0.0)
    ordered = W.partitionBy("run_id", "event_id", "supports").orderBy(load_first, best, "relation_id")
    return relevant.withColumn("ref_no", F.row_number().over(ordered)).where(F.col("ref_no") <= cfg.max_correlation_refs)


def _texts(metrics: Column) -> dict[str, Column]:
    load, host = F.col("positive_load") > 0, F.col("positive_host") > 0
    loaded = F.array_contains(metrics, "utilization")
    queueing = loaded & has_any(metrics, *QUALITY_METRICS) & load
    sensor = host & has_any(metrics, "rtt", "packet_loss")
    interface = has_any(metrics, "drops", "errors")
    lost = has_any(metrics, "packet_loss")

    def choose(*texts: str) -> Column:
        return (F.when(queueing, texts[0]).when(sensor, texts[1]).when(interface, texts[2])
                .when(lost, texts[3]).otherwise(texts[4]))

    level = F.upper("confidence")
    return {
        "interpretation": F.when(loaded & load, F.concat(
            F.lit("Degradación coincidente con mayor carga; asociaciones positivas fuertes: "),
            F.col("load_relations"), F.lit(". No demuestra causalidad.")))
        .when(F.size(metrics) >= 2, "Degradación simultánea en varias métricas; causa física no determinada.")
        .otherwise("Cambio temporal en una métrica; requiere contexto."),
        "hypothesis": choose("Compatible con colas o cuello de botella bajo carga; requiere confirmación.",
                             "Compatible con contribución del host sensor; sin causalidad atribuible.",
                             "Posible incidencia en colas, interfaz o camino; requiere telemetría adicional.",
                             "Posible degradación del camino o destino; requiere comparación entre targets.",
                             "Cambio de causa indeterminada con la evidencia actual."),
        "recommendation": choose("Repetir en hora pico y correlacionar con el elemento aguas arriba.",
                                 "Repetir con captura simultánea de CPU, carga y enlace.",
                                 "Revisar contadores y colas aguas arriba en una ventana equivalente.",
                                 "Repetir con targets internos, externos y de referencia.",
                                 "Extender la ventana y recolectar telemetría relacionada."),
        "finding_confidence": F.when((level == "ALTA") & load, "ALTA").when(level.isin("ALTA", "MEDIA"), "MEDIA").otherwise("BAJA"),
        "confidence_basis": F.when((level == "ALTA") & load, "Evento ALTA con asociación positiva fuerte de carga.")
        .when(level.isin("ALTA", "MEDIA"), "Detección suficiente sin soporte correlacional fuerte.")
        .otherwise("Confianza de detección baja."),
    }


def findings(events: DataFrame, targets: DataFrame, refs: DataFrame) -> DataFrame:
    """One finding per event with its texts, confidence and reference counts."""
    keys = ["run_id", "event_id"]
    positive = F.col("supports") & (F.col("spearman_rho") > 0)
    load = positive & (F.col("kind") == "load_support")
    # At most max_correlation_refs rows per event reach this list.
    first_loads = F.slice(F.array_sort(F.collect_list(F.when(load, F.struct("ref_no", "relation_id")))), 1, 3)
    counted = refs.groupBy(*keys).agg(
        F.count_if("supports").alias("supporting_correlation_count"),
        F.count_if(~F.col("supports")).alias("context_correlation_count"),
        F.count_if(load).alias("positive_load"),
        F.count_if(positive & (F.col("kind") == "host_context")).alias("positive_host"),
        F.array_join(F.transform(first_loads, lambda r: r["relation_id"]), ", ").alias("load_relations"))
    # Targets of one event are few: they come from the run's configuration.
    named = targets.groupBy(*keys).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    counts = ["supporting_correlation_count", "context_correlation_count", "positive_load", "positive_host"]
    rows = events.join(counted, keys, "left").join(named, keys, "left").fillna(0, counts)
    metrics = F.col("metrics_changed")
    fact = F.concat(F.col("event_id"), F.lit(": "), shown(F.col("duration_seconds"), 1), F.lit(" s, "),
                    F.col("anomalous_buckets").cast("string"), F.lit(" buckets anómalos, métricas: "),
                    F.array_join(metrics, ", "))
    base = ["El hallazgo describe solo la ventana observada.",
            "Coincidencia y correlación no demuestran causalidad.",
            "La hipótesis requiere confirmación adicional."]
    extra = "Sin correlación fuerte, suficiente y compatible que eleve la confianza."
    limits = F.array(*[F.lit(t) for t in base])
    texts = _texts(metrics)
    return rows.select(
        "run_id", F.regexp_replace("event_id", "^EVENT", "FINDING").alias("finding_id"), "event_id", "start", "end",
        "duration_seconds", "severity", "metrics_changed",
        F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), fact.alias("fact"),
        texts["interpretation"].alias("interpretation"), texts["hypothesis"].alias("hypothesis"),
        texts["finding_confidence"].alias("confidence"), texts["confidence_basis"].alias("confidence_basis"),
        texts["recommendation"].alias("recommendation"), F.col("confidence").alias("detector_confidence"),
        "anomalous_buckets", "bucket_seconds", *counts[:2],
        F.when(F.col("supporting_correlation_count") == 0, F.array_append(limits, F.lit(extra))).otherwise(limits).alias("limitations"),
        F.lit(False).alias("causal_claim_allowed"))


def evidence_trace(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Lineage rows: the event itself, then each supporting and context correlation."""
    own = found.select(
        "run_id", "finding_id", F.lit("event").alias("source_type"), F.col("event_id").alias("source_id"),
        F.lit("").alias("target"), F.lit(None).cast("long").alias("pair_count"),
        F.lit(None).cast("double").alias("spearman_rho"), F.lit("event_evidence").alias("evidence_status"),
        F.concat(F.col("anomalous_buckets").cast("string"), F.lit(" buckets anómalos")).alias("note"))
    linked = refs.select(
        "run_id", F.regexp_replace("event_id", "^EVENT", "FINDING").alias("finding_id"),
        F.when(F.col("supports"), "supporting_correlations").otherwise("context_correlations").alias("source_type"),
        F.col("relation_id").alias("source_id"), F.coalesce("target", F.lit("")).alias("target"), "pair_count",
        "spearman_rho", "evidence_status", "note")
    return own.unionByName(linked)


def analyze_evidence(events: DataFrame, targets: DataFrame, correlations: DataFrame,
                     cfg: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    cfg.validate()
    return findings(events, targets, top_correlations(event_correlations(events, targets, correlations, cfg), cfg))
