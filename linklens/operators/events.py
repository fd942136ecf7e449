"""Multi-metric degradation events: buckets, baselines, flags, sessions.

Evidence stays in long form, one row per fired signal
(``run_id, timestamp, metric, target, observed, baseline, threshold, reachability``).
Nested documents are built only by the JSON sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.config import EventThresholds
from linklens.functions.scalars import (
    add_seconds, baseline_threshold, bucket_of, flag_list, loss_pct, numbered, seconds_between, status_ok,
)
from linklens.operators.ordered import previous_valid, running_sum, time_chunk
from linklens.operators.quality import source_overlap
from linklens.operators.quantiles import exact_quantiles, quantile_of
from linklens.session import once, stage, together

BUCKETS_PER_CHUNK = 4096


def _both(a: str, b: str) -> Column:
    return F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))


def clip(df: DataFrame, overlap: DataFrame) -> DataFrame:
    """Valid samples inside the closed overlap window of their run."""
    window = overlap.where("overlap_exists").select("run_id", "overlap_start", "overlap_end")
    inside = F.col("timestamp").between(F.col("overlap_start"), F.col("overlap_end"))
    return (df.where(status_ok(df)).join(window, "run_id").where(inside).drop("overlap_start", "overlap_end"))


def iface_buckets(clipped: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """Highest rate and utilization, summed drops and errors per run and bucket."""
    return clipped.groupBy("run_id", bucket_of(clipped, th.bucket_seconds).alias("bucket")).agg(
        F.count(F.lit(1)).alias("interface_samples"), F.max("rx_rate_mbps").alias("rx_rate_mbps"),
        F.max("tx_rate_mbps").alias("tx_rate_mbps"), F.max("utilization_pct").alias("utilization_pct"),
        F.sum(_both("rx_errors_delta", "tx_errors_delta")).cast("double").alias("errors_delta"),
        F.sum(_both("rx_drops_delta", "tx_drops_delta")).cast("double").alias("drops_delta"))


def probe_buckets(clipped: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """Loss, reachability, median RTT and highest delay variation per run, bucket and target."""
    keys = ["run_id", "bucket", "target"]
    rows = clipped.withColumn("bucket", bucket_of(clipped, th.bucket_seconds))
    sums = rows.groupBy(*keys).agg(  # a bucket of one target is bounded
        F.count(F.lit(1)).alias("probe_samples"), quantile_of("rtt_ms", 0.5).alias("rtt_ms"),
        F.sum(F.coalesce("packets_sent", F.lit(0))).cast("double").alias("packets_sent"),
        F.sum(F.coalesce("packets_received", F.lit(0))).cast("double").alias("packets_received"),
        F.bool_and("reachability_bool").alias("reachability"),
        F.max("delay_variation_ms").alias("delay_variation_ms"))
    return sums.withColumn("packet_loss_pct", loss_pct(F.col("packets_sent"), F.col("packets_received")))


def iface_baselines(clipped: DataFrame) -> DataFrame:
    """Per run medians over the raw samples of the overlap."""
    return exact_quantiles(clipped, ["run_id"], {f"base_{c}": (c, 0.5) for c in ("utilization_pct", "rx_rate_mbps", "tx_rate_mbps")})


def probe_baselines(clipped: DataFrame) -> DataFrame:
    """Per run and target medians of RTT, delay variation and per-sample loss."""
    rows = clipped.withColumn("sample_loss_pct", loss_pct(F.col("packets_sent"), F.col("packets_received")))
    return exact_quantiles(rows, ["run_id", "target"], {
        "base_rtt_ms": ("rtt_ms", 0.5), "base_delay_variation_ms": ("delay_variation_ms", 0.5), "base_loss_pct": ("sample_loss_pct", 0.5)})


def baselines(iface_base: DataFrame, probe_base: DataFrame) -> DataFrame:
    """Long form ``run_id, target, metric, baseline`` of both sources."""
    first = iface_base.selectExpr(
        "run_id", "CAST(NULL AS STRING) AS target",
        "stack(3, 'utilization_pct', base_utilization_pct, 'rx_rate_mbps', base_rx_rate_mbps, "
        "'tx_rate_mbps', base_tx_rate_mbps) AS (metric, baseline)")
    second = probe_base.selectExpr(
        "run_id", "target", "stack(3, 'rtt_ms', base_rtt_ms, 'delay_variation_ms', base_delay_variation_ms, "
        "'packet_loss_pct', base_loss_pct) AS (metric, baseline)")
    return first.unionByName(second)


def _signal(fired: Column, metric: str, target: Column, observed: Column, baseline: Column,
            threshold: Column, reachable: Column | None = None) -> Column:
    return F.when(fired, F.struct(
        F.lit(metric).alias("metric"), target.cast("string").alias("target"),
        observed.cast("double").alias("observed"), baseline.cast("double").alias("baseline"),
        threshold.cast("double").alias("threshold"),
        (F.lit(None) if reachable is None else reachable).cast("boolean").alias("reachability")))


def _unfold(df: DataFrame, signals: list[Column]) -> DataFrame:
    return df.select("run_id", F.col("bucket").alias("timestamp"),
                     F.explode(F.array_compact(F.array(*signals))).alias("s")).select("run_id", "timestamp", "s.*")


def limits(th: EventThresholds) -> dict[str, Column]:
    """Dynamic thresholds from the baseline columns."""
    rate = {side: baseline_threshold(F.col(f"base_{side}_rate_mbps"), ratio=th.rate_ratio, delta=th.rate_delta_mbps,
                                     floor=th.rate_delta_mbps) for side in ("rx", "tx")}
    return {**rate,
            "rtt": baseline_threshold(F.col("base_rtt_ms"), ratio=th.rtt_ratio, delta=th.rtt_delta_ms),
            "delay_variation": baseline_threshold(F.col("base_delay_variation_ms"), ratio=th.delay_variation_ratio,
                                                  delta=0.0, floor=th.delay_variation_ms)}


def conditions(th: EventThresholds) -> dict[str, Column]:
    """When each signal fires, over bucket and baseline columns."""
    limit, util, loss = limits(th), F.col("utilization_pct"), F.col("packet_loss_pct")
    jump = F.coalesce(util - F.col("base_utilization_pct") >= th.utilization_delta_pp, F.lit(False))
    return {
        "utilization": (util >= th.utilization_high_pct) | jump,
        "rx": util.isNull() & (F.col("rx_rate_mbps") >= limit["rx"]),
        "tx": util.isNull() & (F.col("tx_rate_mbps") >= limit["tx"]),
        "drops": F.col("drops_delta") >= th.drops_delta, "errors": F.col("errors_delta") >= th.errors_delta,
        "rtt": F.col("rtt_ms") >= limit["rtt"],
        "delay_variation": F.col("delay_variation_ms") >= limit["delay_variation"],
        "packet_loss": loss.isNotNull() & ((loss >= th.packet_loss_pct) | ~F.col("reachability"))}


def iface_signals(buckets: DataFrame, base: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """Fired interface signals in long form."""
    rows, fired, limit, none = buckets.join(base, "run_id", "left"), conditions(th), limits(th), F.lit(None)
    signals = [_signal(fired["utilization"], "utilization", none, F.col("utilization_pct"), F.col("base_utilization_pct"),
                       F.lit(th.utilization_high_pct))]
    for side in ("rx", "tx"):
        signals.append(_signal(fired[side], "traffic_rate", F.lit(side.upper()), F.col(f"{side}_rate_mbps"),
                               F.col(f"base_{side}_rate_mbps"), limit[side]))
    for name, least in (("drops", th.drops_delta), ("errors", th.errors_delta)):
        signals.append(_signal(fired[name], name, none, F.col(f"{name}_delta"), none, F.lit(least)))
    return _unfold(rows, signals)


def probe_signals(buckets: DataFrame, base: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """Fired probe signals in long form."""
    rows, fired, limit = buckets.join(base, ["run_id", "target"], "left"), conditions(th), limits(th)
    target = F.col("target")
    signals = [_signal(fired[m], m, target, F.col(f"{m}_ms"), F.col(f"base_{m}_ms"), limit[m])
               for m in ("rtt", "delay_variation")]
    signals.append(_signal(fired["packet_loss"], "packet_loss", target, F.col("packet_loss_pct"), F.col("base_loss_pct"),
                           F.lit(th.packet_loss_pct), F.col("reachability")))
    return _unfold(rows, signals)


# Metric names of the detector, sorted.
METRICS = ("delay_variation", "drops", "errors", "packet_loss", "rtt", "traffic_rate", "utilization")


def metric_flags(signals: DataFrame) -> DataFrame:
    """Distinct metrics per run and bucket; at most seven names per group."""
    fired = signals.groupBy("run_id", "timestamp").agg(
        *[F.bool_or(F.col("metric") == m).alias(f"_{m}") for m in METRICS])
    return fired.select("run_id", "timestamp", flag_list([(F.col(f"_{m}"), m) for m in METRICS]).alias("metrics_changed"))


def event_timeline(iface: DataFrame, probe: DataFrame, signals: DataFrame,
                   th: EventThresholds = EventThresholds()) -> DataFrame:
    """One row per run and bucket of either source, with flags and the candidate mark."""
    targets = probe.groupBy("run_id", F.col("bucket").alias("timestamp")).agg(F.count(F.lit(1)).alias("probe_targets"))
    keys = ["run_id", "timestamp"]
    line = (iface.withColumnRenamed("bucket", "timestamp").join(targets, keys, "full_outer")
            .join(metric_flags(signals), keys, "left"))
    none = F.array().cast("array<string>")
    return line.withColumns({
        "interface_samples": F.coalesce("interface_samples", F.lit(0)),
        "probe_targets": F.coalesce("probe_targets", F.lit(0)),
        "drops_delta": F.coalesce("drops_delta", F.lit(0.0)), "errors_delta": F.coalesce("errors_delta", F.lit(0.0)),
        "metrics_changed": F.coalesce("metrics_changed", none),
    }).withColumn("metrics_changed_count", F.size("metrics_changed")).withColumn(
        "event_candidate", F.col("metrics_changed_count") >= th.min_metrics_changed)


def sessionize(candidates: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """Adds ``event_no``: candidates of a run no further apart than the merge gap share it."""
    chunk = time_chunk(candidates, "timestamp", BUCKETS_PER_CHUNK * th.bucket_seconds)
    rows = previous_valid(candidates, ["run_id"], ["timestamp"], ["timestamp"], F.lit(True), chunk)
    gap = seconds_between(F.col("_prev.timestamp"), F.col("timestamp"))
    opens = F.when(F.coalesce(gap <= th.merge_gap_seconds, F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("_opens", opens).drop("_prev")
    return running_sum(rows, ["run_id"], ["timestamp"], {"event_no": F.col("_opens")}, chunk).drop("_opens")


def severity(count: Column) -> Column:
    return F.when(count >= 5, "critical").when(count == 4, "high").when(count == 3, "medium").otherwise("low")


def confidence(count: Column, buckets: Column) -> Column:
    lasting = buckets >= 2
    return (F.when((count >= 4) | ((count >= 3) & lasting), "ALTA")
            .when((count >= 3) | lasting, "MEDIA").otherwise("BAJA"))


def candidate_buckets(timeline: DataFrame) -> DataFrame:
    return timeline.where("event_candidate").select("run_id", "timestamp", "metrics_changed", "metrics_changed_count")


def sessions(candidates: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """Candidate buckets with their event number and id."""
    return sessionize(candidates, th).withColumn("event_id", numbered("EVENT", F.col("event_no")))


def events_rollup(buckets: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    """One row per event. The metric union is one flag per known metric, never a growing list."""
    has = lambda m: F.bool_or(F.array_contains("metrics_changed", m)).alias(f"_{m}")
    rolled = buckets.groupBy("run_id", "event_no", "event_id").agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("_last"),
        F.max("metrics_changed_count").alias("max_metrics"), F.count(F.lit(1)).alias("anomalous_buckets"),
        *[has(m) for m in METRICS])
    return (rolled.withColumn("end", add_seconds(F.col("_last"), th.bucket_seconds))
            .select("run_id", "event_no", "event_id", "start", "end",
                    seconds_between(F.col("start"), F.col("end")).alias("duration_seconds"),
                    flag_list([(F.col(f"_{m}"), m) for m in METRICS]).alias("metrics_changed"), "max_metrics",
                    severity(F.col("max_metrics")).alias("severity"),
                    confidence(F.col("max_metrics"), F.col("anomalous_buckets")).alias("confidence"),
                    "anomalous_buckets", F.lit(th.bucket_seconds).alias("bucket_seconds")))


def event_evidence(buckets: DataFrame, signals: DataFrame) -> DataFrame:
    """Fired signals of the candidate buckets with their event."""
    return signals.join(buckets.select("run_id", "timestamp", "event_no", "event_id"), ["run_id", "timestamp"])


def event_targets(evidence: DataFrame) -> DataFrame:
    """Distinct probe targets named by each event, long form."""
    return (evidence.where(F.col("metric").isin("rtt", "delay_variation", "packet_loss") & (F.col("target") != ""))
            .select("run_id", "event_id", "target").distinct())


def event_metadata(timeline: DataFrame, buckets: DataFrame, overlap: DataFrame) -> DataFrame:
    """Counts per run, zero where a run has no overlap."""
    counts = timeline.groupBy("run_id").agg(F.count(F.lit(1)).alias("timeline_buckets"),
                                            F.count_if("event_candidate").alias("candidate_buckets"))
    found = buckets.groupBy("run_id").agg(F.max("event_no").alias("event_count"))
    line = overlap.select("run_id", F.col("overlap_exists").alias("event_detection_executed")).join(
        counts, "run_id", "left").join(found, "run_id", "left")
    return line.fillna(0, ["timeline_buckets", "candidate_buckets", "event_count"])


class EventStages:
    """The stages of one analysis over many runs.

    Tables that several later stages read are written once to the shared
    folder: recomputing them per consumer would multiply the scan of the
    samples, and a written table survives executor loss. Stages are built on
    first use.
    """

    def __init__(self, interface: DataFrame, probes: DataFrame, th: EventThresholds = EventThresholds()):
        self.th = th.validate()
        self._interface, self._probes = interface, probes

    @once
    def interface(self) -> DataFrame:
        return stage(self._interface, "interface")

    @once
    def probes(self) -> DataFrame:
        return stage(self._probes, "probes")

    def load(self) -> None:
        together(lambda: self.interface, lambda: self.probes)

    @once
    def overlap(self) -> DataFrame:
        self.load()
        return stage(source_overlap(self.interface, self.probes, strict=True), "overlap")

    @once
    def iface_clipped(self) -> DataFrame:
        return clip(self.interface, self.overlap)

    @once
    def probe_clipped(self) -> DataFrame:
        return clip(self.probes, self.overlap)

    @once
    def iface_buckets(self) -> DataFrame:
        return stage(iface_buckets(self.iface_clipped, self.th), "iface_buckets")

    @once
    def probe_buckets(self) -> DataFrame:
        return stage(probe_buckets(self.probe_clipped, self.th), "probe_buckets")

    @once
    def iface_base(self) -> DataFrame:
        return stage(iface_baselines(self.iface_clipped), "iface_base")

    @once
    def probe_base(self) -> DataFrame:
        return stage(probe_baselines(self.probe_clipped), "probe_base")

    def summarize(self) -> None:
        """Buckets and baselines of both sources; each reads only samples and overlap."""
        _ = self.overlap
        together(lambda: self.iface_buckets, lambda: self.probe_buckets, lambda: self.iface_base, lambda: self.probe_base)

    @once
    def signals(self) -> DataFrame:
        self.summarize()
        return stage(iface_signals(self.iface_buckets, self.iface_base, self.th).unionByName(
            probe_signals(self.probe_buckets, self.probe_base, self.th)), "signals")

    @once
    def timeline(self) -> DataFrame:
        return event_timeline(self.iface_buckets, self.probe_buckets, self.signals, self.th)

    @once
    def buckets(self) -> DataFrame:
        candidates = stage(candidate_buckets(self.timeline), "candidates")
        return stage(sessions(candidates, self.th), "sessions")

    @once
    def events(self) -> DataFrame:
        return stage(events_rollup(self.buckets, self.th), "events")

    @once
    def evidence(self) -> DataFrame:
        return stage(event_evidence(self.buckets, self.signals), "evidence")

    @once
    def targets(self) -> DataFrame:
        return stage(event_targets(self.evidence), "targets")


def analyze_events(interface: DataFrame, probes: DataFrame, th: EventThresholds = EventThresholds()) -> DataFrame:
    return EventStages(interface, probes, th).events
