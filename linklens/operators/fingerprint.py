"""Comparable event vectors built from the long evidence table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.config import FingerprintConfig
from linklens.functions.scalars import is_ntz, micros, pct_delta

VECTOR_VERSION = "event-fingerprint-v1"  # fixed value: version tag of the vector
PERCENT_METRICS = ("rtt", "delay_variation", "traffic_rate")
COUNT_METRICS = ("drops", "errors")
KEYS = ["run_id", "event_id"]


def loss_baseline(evidence: DataFrame, probe_base: DataFrame) -> DataFrame:
    """Loss rows without their own baseline take the run's baseline of the target."""
    base = probe_base.select("run_id", "target", F.col("base_loss_pct").alias("_run_base"))
    filled = F.when(F.col("metric") == "packet_loss", F.coalesce("baseline", "_run_base")).otherwise(F.col("baseline"))
    return evidence.join(base, ["run_id", "target"], "left").withColumn("baseline", filled).drop("_run_base")


def fingerprint_trace(evidence: DataFrame) -> DataFrame:
    """Every observed signal of an event with its change and unit."""
    metric, change = F.col("metric"), F.col("observed") - F.col("baseline")
    delta = (F.when(metric.isin(*PERCENT_METRICS), pct_delta(F.col("observed"), F.col("baseline")))
             .when(metric.isin(*COUNT_METRICS), F.col("observed")).otherwise(change))
    unit = F.when(metric.isin(*PERCENT_METRICS), "%").when(metric.isin(*COUNT_METRICS), "count").otherwise("pp")
    baseline = F.when(~metric.isin(*COUNT_METRICS), F.col("baseline"))
    return evidence.select("run_id", F.concat(F.lit("FP-"), F.col("event_id")).alias("fingerprint_id"), "event_id",
                           "metric", "target", "timestamp", baseline.alias("baseline"), "observed", delta.alias("delta"),
                           unit.alias("unit"))


def fingerprint_extremes(trace: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Per event, metric and target the row with the largest absolute change.

    Only where no row of the group has a change does the absolute key decide:
    the value for utilization and loss, the plain difference for the others.
    The earliest row wins ties.
    """
    change = F.col("observed") - F.col("baseline")
    fallback = F.when(F.col("metric").isin(*PERCENT_METRICS), change).otherwise(F.col("observed"))
    rows = trace.where(~F.col("metric").isin(*COUNT_METRICS)).withColumn(
        "_key", F.abs(F.coalesce("delta", fallback))).where(F.col("_key").isNotNull())
    order = F.struct(F.col("delta").isNotNull(), F.col("_key"), -micros(F.col("timestamp"), is_ntz(trace, "timestamp")))
    picked = rows.groupBy(*KEYS, "metric", "target").agg(
        F.max_by(F.struct("timestamp", "baseline", "observed", "delta"), order).alias("x"))

    def short(c: Column) -> Column:
        return F.bround(c, cfg.round_digits)

    return picked.select(
        *KEYS, "metric", "target", F.col("x.timestamp").alias("timestamp"), short(F.col("x.baseline")).alias("baseline"),
        short(F.col("x.observed")).alias("peak"), short(F.col("x.delta")).alias("delta"),
        F.when(F.col("metric").isin(*PERCENT_METRICS), short(F.col("x.observed") - F.col("x.baseline"))).alias("delta_abs"))


def compact_vectors(extremes: DataFrame, trace: DataFrame, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Per event the strongest change of each metric with its target; first target on ties."""
    def strongest(metric: str, value: Column, size: Column) -> Column:
        here = (F.col("metric") == metric) & value.isNotNull()
        return F.min_by(F.when(here, F.struct(F.col("target").alias("target"), value.alias("value"))),
                        F.when(here, F.struct(-size, F.col("target"))))

    delta, peak = F.col("delta"), F.col("peak")
    vector = extremes.groupBy(*KEYS).agg(
        F.max(F.when(F.col("metric") == "utilization", delta)).alias("delta_utilization_pp"),
        F.count_if(F.col("metric") == "utilization").alias("_util_rows"),
        strongest("rtt", delta, F.abs(delta)).alias("_rtt"),
        strongest("delay_variation", delta, F.abs(delta)).alias("_delay"),
        strongest("packet_loss", delta, F.abs(delta)).alias("_loss"),
        strongest("packet_loss", peak, peak).alias("_peak"))
    counted = trace.where(F.col("metric").isin(*COUNT_METRICS)).groupBy(*KEYS).agg(
        F.bround(F.sum(F.when(F.col("metric") == "drops", F.col("observed"))), cfg.round_digits).alias("delta_drops"),
        F.bround(F.sum(F.when(F.col("metric") == "errors", F.col("observed"))), cfg.round_digits).alias("delta_errors"))
    both = vector.join(counted, KEYS, "full_outer")
    named = {"_rtt": ("delta_rtt_pct", "delta_rtt_target"),
             "_delay": ("delta_delay_variation_pct", "delta_delay_variation_target"),
             "_loss": ("delta_loss_pp", "delta_loss_target"),
             "_peak": ("observed_loss_peak_pct", "observed_loss_target")}
    for source, (value, target) in named.items():
        both = both.withColumns({value: F.col(f"{source}.value"), target: F.col(f"{source}.target")})
    return both.drop(*named)


def fingerprints(events: DataFrame, targets: DataFrame, trace: DataFrame,
                 cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """One vector per event, with completeness, limitations and a content hash."""
    vectors = compact_vectors(fingerprint_extremes(trace, cfg), trace, cfg)
    named = targets.groupBy(*KEYS).agg(F.array_sort(F.collect_set("target")).alias("targets"))
    core = ("delta_utilization_pp", "delta_rtt_pct", "delta_delay_variation_pct", "delta_loss_pp", "delta_drops")
    available = sum((F.col(c).isNotNull().cast("int") for c in core[1:]), F.col(core[0]).isNotNull().cast("int"))
    shows = lambda m: F.array_contains("metrics_changed", m)
    limits = F.array_compact(F.array(
        F.when(shows("packet_loss") & F.col("observed_loss_peak_pct").isNotNull() & F.col("delta_loss_pp").isNull(),
               "Δloss N/D: pérdida observada sin baseline"),
        F.when(shows("utilization") & F.coalesce(F.col("_util_rows") == 0, F.lit(True)),
               "Δutilization N/D: sin valor utilizable"),
        F.when(shows("rtt") & F.col("delta_rtt_target").isNull(), "ΔRTT N/D: sin baseline distinto de cero"),
        F.when(shows("delay_variation") & F.col("delta_delay_variation_target").isNull(),
               "Δdelay_variation N/D: sin baseline distinto de cero")))
    rows = events.join(vectors, KEYS, "left").join(named, KEYS, "left").select(
        "run_id", F.concat(F.lit("FP-"), F.col("event_id")).alias("fingerprint_id"),
        F.lit(VECTOR_VERSION).alias("vector_version"), "event_id", "start", "end",
        F.bround("duration_seconds", cfg.round_digits).alias("duration_seconds"), "severity", "confidence",
        "metrics_changed", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"),
        core[0], core[1], "delta_rtt_target", core[2], "delta_delay_variation_target", core[3], "delta_loss_target",
        "observed_loss_peak_pct", "observed_loss_target", core[4], "delta_errors",
        available.alias("core_metrics_available"), F.lit(len(core)).alias("core_metrics_total"),
        F.bround(available / len(core) * 100.0, cfg.round_digits).alias("core_completeness_pct"),
        limits.alias("limitations"), F.lit(False).alias("causal_interpretation_allowed"))
    content = F.struct(*[F.col(c) for c in sorted(rows.columns)])
    return rows.withColumn("fingerprint_sha256", F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))


def analyze_fingerprints(events: DataFrame, targets: DataFrame, evidence: DataFrame, probe_base: DataFrame | None = None,
                         cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    cfg.validate()
    rows = evidence if probe_base is None else loss_baseline(evidence, probe_base)
    return fingerprints(events, targets, fingerprint_trace(rows), cfg)
