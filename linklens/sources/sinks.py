"""Writers of result tables and documents.

Every sink takes lazy tables and one output folder and returns the paths it
wrote. Tables keep their partitioning; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions.scalars import is_ntz, micros

BUCKETS_PER_PART = 1000
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), order_by: Sequence[str] = ()) -> str:
    """``order_by`` sorts the rows of each file, so that row groups prune on its first column."""
    if partition_by:  # whole partitions per task, large ones split, small ones merged
        df = df.hint("rebalance", *partition_by)
    if order_by:
        df = df.sortWithinPartitions(*partition_by, *order_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt in ("csv", "json"):  # keep microseconds
        writer = writer.option("timestampNTZFormat", MICROS).option("timestampFormat", f"{MICROS}XXX")
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "parquet",
                 partition_by: Mapping[str, Sequence[str]] | None = None, order_by: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    return {name: write_table(df, f"{out_dir}/{name}", fmt, (partition_by or {}).get(name, ()), (order_by or {}).get(name, ()))
            for name, df in tables.items()}


# Accepted history rows are stored by link and time.
CLEAN_ORDER = {"processed": ["link_id", "timestamp"]}


def flat(df: DataFrame) -> DataFrame:
    """Arrays of text as ``|``-joined text, other nested columns as JSON text."""
    def one(f):
        kind = f.dataType.simpleString()
        if kind == "array<string>":
            return F.array_join(f.name, "|").alias(f.name)
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(F.col(f.name), {"ignoreNullFields": "false"}).alias(f.name)
        return F.col(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


def write_history(out_dir: str, summary, alerts, daily, hourly, processed, rejected) -> dict[str, str]:
    tables = {"summary": summary, "alerts": alerts, "daily": daily, "hourly": hourly, "processed": processed,
              "rejected": rejected}
    paths = write_tables(tables, out_dir, partition_by={"processed": ["date"]}, order_by=CLEAN_ORDER)
    paths["diagnosis"] = write_table(summary, f"{out_dir}/diagnosis", "json")
    return paths


def write_link_audit(out_dir: str, summary, processed, manifest) -> dict[str, str]:
    paths = write_tables({"summary": summary, "processed": processed}, out_dir, partition_by={"processed": ["date"]}, order_by=CLEAN_ORDER)
    paths["manifest"] = write_table(manifest, f"{out_dir}/manifest", "json")
    return paths


def write_quality(out_dir: str, interface_summary, probe_summary, interface, probes, overlap) -> dict[str, str]:
    paths = write_tables({"interface_summary": interface_summary, "probe_summary": probe_summary,
                          "interface_processed": interface, "probe_processed": probes}, out_dir)
    paths["windows"] = write_table(overlap, f"{out_dir}/windows", "json")
    return paths


def event_documents(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """One JSON document per event and part; a part holds the signals of at most 1000 buckets.

    Part 0 always exists and carries the header, so a long event never becomes one huge row.
    """
    seconds = events.select("run_id", "event_id", "start", "bucket_seconds")
    ntz = is_ntz(evidence, "timestamp")
    span = F.col("bucket_seconds").cast("long") * 1_000_000 * BUCKETS_PER_PART
    part = F.floor((micros(F.col("timestamp"), ntz) - micros(F.col("start"), ntz)) / span).cast("long")
    signals = F.struct("metric", "target", "observed", "baseline", "threshold", "reachability")
    per_bucket = (evidence.join(seconds, ["run_id", "event_id"]).withColumn("part_no", part)
                  .groupBy("run_id", "event_id", "part_no", "timestamp").agg(F.array_sort(F.collect_list(signals)).alias("signals")))
    parts = per_bucket.groupBy("run_id", "event_id", "part_no").agg(
        F.array_sort(F.collect_list(F.struct("timestamp", "signals"))).alias("buckets"))
    return parts.join(events, ["run_id", "event_id"]).select(
        "run_id", "event_id", "start", "end", "duration_seconds", "metrics_changed", "severity", "confidence", "part_no",
        F.struct("bucket_seconds", "anomalous_buckets", "buckets").alias("evidence"))


def write_events(out_dir: str, events, evidence, timeline) -> dict[str, str]:
    paths = write_tables({"timeline": flat(timeline), "summary": flat(events)}, out_dir)
    paths["events"] = write_table(event_documents(events, evidence), f"{out_dir}/events", "json")
    return paths


def write_correlations(out_dir: str, correlations, aligned) -> dict[str, str]:
    paths = write_tables({"summary": correlations, "aligned_pairs": aligned}, out_dir)
    paths["correlations"] = write_table(correlations, f"{out_dir}/correlations", "json")
    return paths


def write_evidence(out_dir: str, findings, trace) -> dict[str, str]:
    paths = write_tables({"summary": flat(findings), "trace": trace}, out_dir)
    paths["findings"] = write_table(findings, f"{out_dir}/findings", "json")
    return paths


def write_fingerprints(out_dir: str, fingerprints, trace) -> dict[str, str]:
    paths = write_tables({"summary": flat(fingerprints), "trace": trace}, out_dir)
    paths["fingerprints"] = write_table(fingerprints, f"{out_dir}/fingerprints", "json")
    return paths


def write_dataset_quality(out_dir: str, gate, profile, checks) -> dict[str, str]:
    paths = write_tables({"sources": profile, "checks": checks}, out_dir)
    paths["gate"] = write_table(gate, f"{out_dir}/gate", "json")
    return paths


def write_checksums(out_dir: str, metadata, lines) -> dict[str, str]:
    """Manifest lines per run, in path order inside each file, and the run metadata."""
    ordered = lines.repartitionByRange("run_id", "path").sortWithinPartitions("run_id", "path").select("run_id", F.col("line").alias("value"))
    ordered.write.mode("overwrite").partitionBy("run_id").text(f"{out_dir}/checksums")
    return {"checksums": f"{out_dir}/checksums", "metadata": write_table(metadata, f"{out_dir}/metadata", "json")}


def write_report_tables(out_dir: str, report, manifest) -> dict[str, str]:
    return {"report": write_table(report, f"{out_dir}/report", "json", ["section"]),
            "manifest": write_table(manifest, f"{out_dir}/manifest", "json")}
