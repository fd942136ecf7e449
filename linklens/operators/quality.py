"""Processed series and per-interface / per-target quality over the observed window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions.scalars import number_of, seconds_between, to_bool
from linklens.operators.counters import counter_delta, delay_variation, elapsed_valid
from linklens.operators.quantiles import exact_quantiles

DELTAS = ("rx_bytes_delta", "tx_bytes_delta", "rx_errors_delta", "tx_errors_delta", "rx_drops_delta", "tx_drops_delta")
PROBE_NUMBERS = ("packets_sent", "packets_received", "packet_loss_pct", "rtt_ms", "rtt_min_ms", "rtt_max_ms",
                 "delay_variation_ms")


def processed_interface(df: DataFrame, runs: DataFrame | None = None,
                        maxima: Mapping[str, int] | None = None) -> DataFrame:
    """Interface samples with rates and utilization.

    ``runs`` supplies ``capacity_mbps`` per run; the speed a card reports is
    never used. Deltas are computed from the counters unless the samples
    already carry them.
    """
    if "rx_bytes_delta" in df.columns:
        rows = elapsed_valid(df.withColumns({c: number_of(df, c) for c in DELTAS if c in df.columns}))
    else:
        rows = counter_delta(df, maxima)
    return with_rates(rows, runs)


def with_rates(rows: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Adds rates and utilization to samples that carry deltas and ``elapsed_seconds``."""
    rows = rows.withColumns({c: F.lit(None).cast("long") for c in DELTAS if c not in rows.columns})
    if runs is None:
        rows = rows.withColumn("capacity_mbps", F.lit(None).cast("double"))
    else:
        rows = rows.join(runs.select("run_id", "capacity_mbps"), "run_id", "left")
    capacity = F.when(F.col("capacity_mbps") > 0, F.col("capacity_mbps"))

    def rate(name):
        mbps = F.when(F.col("sample_ok") & (F.col("elapsed_seconds") > 0),
                      F.col(name) * 8.0 / F.col("elapsed_seconds") / 1e6)
        return F.when(mbps >= 0, mbps)

    return (rows.withColumns({"rx_rate_mbps": rate("rx_bytes_delta"), "tx_rate_mbps": rate("tx_bytes_delta")})
            .withColumns({"rx_utilization_pct": F.col("rx_rate_mbps") / capacity * 100.0,
                          "tx_utilization_pct": F.col("tx_rate_mbps") / capacity * 100.0})
            .withColumn("utilization_pct", F.greatest("rx_utilization_pct", "tx_utilization_pct")))


def processed_probes(df: DataFrame) -> DataFrame:
    """Probe samples with numeric cells, ``reachability_bool`` and delay variation."""
    rows = df.withColumns({c: number_of(df, c) for c in PROBE_NUMBERS if c in df.columns})
    rows = rows.withColumn("reachability_bool",
                           to_bool(F.col("reachability")) if "reachability" in df.columns
                           else F.coalesce(F.col("packets_received") > 0, F.lit(False)))
    return rows if "delay_variation_ms" in df.columns else delay_variation(rows)


def interface_summary(processed: DataFrame) -> DataFrame:
    keys = ["run_id", "interface"]
    ok = F.col("sample_ok")
    valid = processed.where(ok)
    totals = [F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))).cast("long").alias(f"{c}_total")
              for c in DELTAS if "bytes" not in c]
    counts = processed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(ok).alias("valid_samples"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.max("capacity_mbps").alias("capacity_mbps"),
        *[agg(F.when(ok, F.col(c))).alias(f"{name}_{stat}_{unit}")
          for c, name, unit in (("rx_rate_mbps", "rx_rate", "mbps"), ("tx_rate_mbps", "tx_rate", "mbps"),
                                ("utilization_pct", "utilization", "pct"))
          for stat, agg in (("mean", F.avg), ("max", F.max))], *totals)
    p95 = exact_quantiles(valid, keys, {"rx_rate_p95_mbps": ("rx_rate_mbps", 0.95),
                                        "tx_rate_p95_mbps": ("tx_rate_mbps", 0.95),
                                        "utilization_p95_pct": ("utilization_pct", 0.95)})
    return (counts.join(p95, keys, "left")
            .withColumn("duration_seconds", seconds_between(F.col("first_timestamp"), F.col("last_timestamp"))))


def probe_summary(processed: DataFrame) -> DataFrame:
    """Per run and target. Rows in error count too."""
    keys = ["run_id", "target"]
    sent, received = (F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long") for c in ("packets_sent", "packets_received"))
    counts = processed.groupBy(*keys).agg(
        F.min_by("address", F.struct("timestamp", "row_no")).alias("address"),
        F.count(F.lit(1)).alias("samples"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"), sent.alias("total_probes"), received.alias("successful_probes"),
        (F.avg(F.col("reachability_bool").cast("int")) * 100.0).alias("availability_observed_pct"),
        F.min("rtt_ms").alias("rtt_min_ms"), F.max("rtt_ms").alias("rtt_max_ms"),
        F.max("delay_variation_ms").alias("delay_variation_max_ms"))
    shape = exact_quantiles(processed, keys, {
        "rtt_median_ms": ("rtt_ms", 0.5), "rtt_p95_ms": ("rtt_ms", 0.95), "rtt_p99_ms": ("rtt_ms", 0.99),
        "delay_variation_median_ms": ("delay_variation_ms", 0.5), "delay_variation_p95_ms": ("delay_variation_ms", 0.95)})
    lost = F.greatest(F.col("total_probes") - F.col("successful_probes"), F.lit(0))
    return (counts.join(shape, keys, "left").withColumns({
        "lost_probes": lost, "loss_percent": F.when(F.col("total_probes") > 0, lost / F.col("total_probes") * 100.0),
        "duration_seconds": seconds_between(F.col("first_timestamp"), F.col("last_timestamp"))}))


def source_overlap(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Per run: union and overlap of two sources.

    ``strict`` asks for a positive overlap (events, correlations); otherwise a
    shared instant is enough (quality).
    """
    def window(df, side):
        return df.groupBy("run_id").agg(F.min("timestamp").alias(f"{side}_first"), F.max("timestamp").alias(f"{side}_last"))

    both = window(left, "left").join(window(right, "right"), "run_id")
    start, end = F.greatest("left_first", "right_first"), F.least("left_last", "right_last")
    exists = end > start if strict else end >= start
    union_first, union_last = F.least("left_first", "right_first"), F.greatest("left_last", "right_last")
    return both.select(
        "run_id", exists.alias("overlap_exists"), F.when(exists, start).alias("overlap_start"),
        F.when(exists, end).alias("overlap_end"),
        F.when(exists, seconds_between(start, end)).otherwise(0.0).alias("overlap_seconds"),
        union_first.alias("union_first"), union_last.alias("union_last"),
        seconds_between(union_first, union_last).alias("union_span_seconds"))
