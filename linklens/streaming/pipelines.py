"""Landed files to streaming tables: ingest, buckets, sessions, de-duplication, late rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.config import DatasetQualityConfig, EventThresholds
from linklens.functions.scalars import (
    add_seconds, as_instant, as_wall_clock, flag_list, is_ntz, loss_pct, seconds_between,
)
from linklens.operators.events import METRICS, _both, conditions, confidence, severity
from linklens.operators.profile import outside_window
from linklens.session import scratch_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Files of one micro-batch: bounds what a key can bring to its task at once, also when a backlog is worked off.
MAX_FILES = 64


def read_landed(spark: SparkSession, path: str, like: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """A stream over landed parquet files with a fixed schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(path)


# Seconds between two looks at a running query's progress, of which Spark keeps only the latest updates.
LOOK = 0.2


def run_available(stream: DataFrame, sink: str, checkpoint: str, progress: str | None = None) -> dict[str, int]:
    """Process everything that has landed, append to a parquet table, stop.

    Returns the rows read and the rows that came too late for the watermark, which Spark drops, over all micro-batches of the run; ``progress``
    names a table that gets one row for each. A micro-batch whose numbers were missed is an error, never a smaller sum.
    """
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
             .option("path", sink).trigger(availableNow=True).start())
    seen: dict[int, tuple[int, int]] = {}

    def look() -> None:
        for step in query.recentProgress:
            batch = (step.numInputRows, sum(op.numRowsDroppedByWatermark for op in step.stateOperators))
            seen[step.batchId] = max(seen.get(step.batchId, batch), batch)

    while not query.awaitTermination(LOOK):
        look()
    look()
    if seen and len(seen) != max(seen) - min(seen) + 1:
        raise RuntimeError("progress of a micro-batch was missed; raise spark.sql.streaming.numRecentProgressUpdates")
    if progress is not None:
        stream.sparkSession.createDataFrame([(batch, *numbers) for batch, numbers in sorted(seen.items())], PROGRESS).write.mode("append").parquet(progress)
    return {"input_rows": sum(n for n, _ in seen.values()), "dropped_by_watermark": sum(n for _, n in seen.values())}


PROGRESS = "batch_id long, input_rows long, dropped_by_watermark long"


def land_and_run(slices: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Land each slice in turn and run the stream after each; returns the sink table.

    Every run resumes from the checkpoint of the one before, so state, offsets
    and sink commits are carried across restarts.
    """
    return _land_and_run(slices, build)[0]


def land_and_count(slices: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], max_files: int = MAX_FILES) -> DataFrame:
    """As ``land_and_run``, but returns what each micro-batch read and dropped: ``landing`` (from 1) and the columns of ``PROGRESS``."""
    return _land_and_run(slices, build, max_files)[1]


def _land_and_run(slices: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame], max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    spark = slices[0].sparkSession
    provider = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # keyed state needs it; the session's own choice comes back afterwards
    try:
        landing, sink, checkpoint, progress = (scratch_dir(spark, part) for part in ("landing", "sink", "offsets", "progress"))
        out = None
        for number, piece in enumerate(slices, 1):
            piece.write.mode("append").parquet(landing)
            out = build(read_landed(spark, landing, slices[0], max_files))
            run_available(out, sink, checkpoint, f"{progress}/landing={number}")
    finally:
        if provider is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, provider)
    return spark.read.schema(out.schema).parquet(sink), spark.read.schema(f"{PROGRESS}, landing int").parquet(progress)


def watermarked(stream: DataFrame, lateness: str) -> DataFrame:
    if is_ntz(stream, "timestamp"):
        stream = stream.withColumn("timestamp", as_instant(F.col("timestamp")))
    return stream.withWatermark("timestamp", lateness)


def bucket_window(th: EventThresholds) -> Column:
    return F.window("timestamp", f"{th.bucket_seconds} seconds")


def stream_iface_buckets(stream: DataFrame, th: EventThresholds, lateness: str = "1 hour") -> DataFrame:
    """Tumbling interface buckets, emitted when the watermark passes them."""
    return (watermarked(stream, lateness).where("sample_ok").groupBy("run_id", bucket_window(th).alias("w")).agg(
        F.count(F.lit(1)).alias("interface_samples"), F.max("rx_rate_mbps").alias("rx_rate_mbps"),
        F.max("tx_rate_mbps").alias("tx_rate_mbps"), F.max("utilization_pct").alias("utilization_pct"),
        F.sum(_both("rx_errors_delta", "tx_errors_delta")).cast("double").alias("errors_delta"),
        F.sum(_both("rx_drops_delta", "tx_drops_delta")).cast("double").alias("drops_delta"))
        .select("run_id", as_wall_clock(F.col("w.start")).alias("bucket"), "interface_samples", "rx_rate_mbps", "tx_rate_mbps",
                "utilization_pct", "errors_delta", "drops_delta"))


def stream_probe_buckets(stream: DataFrame, th: EventThresholds, lateness: str = "1 hour") -> DataFrame:
    ok = F.col("sample_status") == "ok"
    rows = (watermarked(stream, lateness).where(ok)
            .groupBy("run_id", "target", bucket_window(th).alias("w")).agg(
        F.count(F.lit(1)).alias("probe_samples"), F.sum("packets_sent").cast("double").alias("packets_sent"),
        F.sum("packets_received").cast("double").alias("packets_received"),
        F.bool_and("reachability_bool").alias("reachability"), F.max("delay_variation_ms").alias("delay_variation_ms")))
    return rows.select("run_id", as_wall_clock(F.col("w.start")).alias("bucket"), "target", "probe_samples", "packets_sent",
                       "packets_received", "reachability", "delay_variation_ms",
                       loss_pct(F.col("packets_sent"), F.col("packets_received")).alias("packet_loss_pct"))


def combined_samples(interface: DataFrame, probes: DataFrame) -> DataFrame:
    """Both sources in one time-ordered table; the columns of the other source are null."""
    left = interface.where("sample_ok").select(
        "run_id", "timestamp", F.lit("").alias("target"), "utilization_pct", "rx_rate_mbps", "tx_rate_mbps",
        _both("rx_drops_delta", "tx_drops_delta").cast("double").alias("drops_delta"),
        _both("rx_errors_delta", "tx_errors_delta").cast("double").alias("errors_delta"))
    right = probes.where(F.col("sample_status") == "ok").select(
        "run_id", "timestamp", "target", F.col("packets_sent").cast("double").alias("packets_sent"),
        F.col("packets_received").cast("double").alias("packets_received"), "rtt_ms", "delay_variation_ms", "reachability_bool")
    return left.unionByName(right, allowMissingColumns=True)


def stream_events(stream: DataFrame, iface_base: DataFrame, probe_base: DataFrame, overlap: DataFrame,
                  th: EventThresholds, lateness: str = "1 hour") -> DataFrame:
    """Events from the combined sample stream against static baselines.

    Three chained stateful steps in append mode: bucket per target, bucket per
    run, session per run. Baselines cover the whole capture and therefore come
    from a batch table, as does the overlap window.
    """
    window = overlap.where("overlap_exists").select("run_id", "overlap_start", "overlap_end")
    if is_ntz(overlap, "overlap_start"):
        window = window.withColumns({c: as_instant(F.col(c)) for c in ("overlap_start", "overlap_end")})
    rows = (watermarked(stream, lateness).join(window, "run_id")
            .where(F.col("timestamp").between(F.col("overlap_start"), F.col("overlap_end"))))
    buckets = rows.groupBy("run_id", "target", bucket_window(th).alias("w")).agg(
        F.max("utilization_pct").alias("utilization_pct"), F.max("rx_rate_mbps").alias("rx_rate_mbps"),
        F.max("tx_rate_mbps").alias("tx_rate_mbps"), F.sum("drops_delta").alias("drops_delta"),
        F.sum("errors_delta").alias("errors_delta"), F.sum("packets_sent").alias("_sent"),
        F.sum("packets_received").alias("_got"), F.median("rtt_ms").alias("rtt_ms"),
        F.max("delay_variation_ms").alias("delay_variation_ms"), F.bool_and("reachability_bool").alias("reachability"))
    based = (buckets.join(iface_base, "run_id", "left").join(probe_base, ["run_id", "target"], "left")
             .withColumn("packet_loss_pct", loss_pct(F.col("_sent"), F.col("_got"))))
    fired = conditions(th)
    fired["traffic_rate"] = F.coalesce(fired["rx"], F.lit(False)) | F.coalesce(fired["tx"], F.lit(False))
    flagged = based.groupBy("run_id", F.window(F.window_time("w"), f"{th.bucket_seconds} seconds").alias("w")).agg(
        *[F.bool_or(F.coalesce(fired[m], F.lit(False))).alias(m) for m in METRICS])
    changed = sum((F.col(m).cast("int") for m in METRICS[1:]), F.col(METRICS[0]).cast("int"))
    candidates = flagged.withColumn("changed", changed).where(F.col("changed") >= th.min_metrics_changed)
    events = candidates.groupBy("run_id", F.session_window(F.window_time("w"), f"{th.merge_gap_seconds} seconds").alias("s")).agg(
        as_wall_clock(F.min("w.start")).alias("start"), as_wall_clock(F.max("w.start")).alias("_last"), F.max("changed").alias("max_metrics"),
        F.count(F.lit(1)).alias("anomalous_buckets"), *[F.bool_or(m).alias(m) for m in METRICS])
    end = add_seconds(F.col("_last"), th.bucket_seconds)
    return events.select(
        "run_id", "start", end.alias("end"), seconds_between(F.col("start"), end).alias("duration_seconds"),
        F.array_join(flag_list([(F.col(m), m) for m in METRICS]), "|").alias("metrics_changed"), "max_metrics",
        severity(F.col("max_metrics")).alias("severity"),
        confidence(F.col("max_metrics"), F.col("anomalous_buckets")).alias("confidence"), "anomalous_buckets")


def stream_dedup(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First copy of each link and instant within the watermark."""
    ntz = is_ntz(stream, "timestamp")
    kept = watermarked(stream, lateness).dropDuplicatesWithinWatermark(["timestamp", "link_id"])
    return kept.withColumn("timestamp", as_wall_clock(F.col("timestamp"))) if ntz else kept


def stream_late_rows(stream: DataFrame, runs: DataFrame, cfg: DatasetQualityConfig = DatasetQualityConfig()) -> DataFrame:
    """Rows outside the window of their run and its tolerance."""
    return stream.join(runs.select("run_id", "started", "ended"), "run_id").where(outside_window(runs, cfg)).drop("started", "ended")
