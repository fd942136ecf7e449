"""Readers of landed tables and documents."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.functions.scalars import to_timestamp
from linklens.operators.ingest import map_columns, require_columns

DELIMITERS = (",", ";", "\t", "|")

EVENT_SCHEMA = """
run_id string, event_id string, start timestamp_ntz, end timestamp_ntz, duration_seconds double,
metrics_changed array<string>, severity string, confidence string, part_no bigint,
evidence struct<bucket_seconds: int, anomalous_buckets: bigint, buckets: array<struct<
  timestamp: timestamp_ntz, signals: array<struct<metric: string, target: string, observed: double, baseline: double,
  threshold: double, reachability: boolean>>>>>"""

CORRELATION_SCHEMA = """
run_id string, relation_id string, x_metric string, y_metric string, target string, pair_count bigint, spearman_rho double,
abs_rho double, direction string, strength string, sufficient_samples boolean, evidence_status string,
descriptive_significance string, first_timestamp timestamp_ntz, last_timestamp timestamp_ntz,
causal_interpretation_allowed boolean, note string"""

CONFIG_SCHEMA = """
run struct<run_id: string, duration_seconds: double>,
interface struct<name: string, interval_seconds: double, capacity_mbps: double>, host struct<interval_seconds: double>,
probes struct<interval_seconds: double, timeout_ms: int, payload_bytes: int, count_per_target: int>,
targets array<struct<name: string, address: string, role: string>>"""


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that occurs most often in the header line."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"no rows in {path}")
    return max(DELIMITERS, key=header[0].count)


def read_history(spark: SparkSession, path: str, mapping: Mapping[str, str] | None = None,
                 delimiter: str | None = None, file_format: str | None = None) -> DataFrame:
    """Link history as text CSV (byte-order mark tolerated) or parquet, with canonical column names.

    ``file_format`` is ``csv`` or ``parquet``; without it the path's ending decides. CSV headers are checked per file, so files
    of one folder may not order their columns differently without an error.

    ``row_no`` is the file order. Landed files should carry it; without it the
    scan position stands in, which is only meaningful for one file.
    """
    kind = file_format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if kind == "parquet":
        raw = spark.read.parquet(path)
    elif kind == "csv":
        sep = delimiter or sniff_delimiter(spark, path)
        columns = spark.read.csv(path, header=True, inferSchema=False, sep=sep).schema
        raw = spark.read.schema(columns).csv(path, header=True, sep=sep, enforceSchema=False)
    else:
        raise ValueError(f"unknown format {kind}")
    df = map_columns(raw, mapping)
    if "row_no" in df.columns:
        return df.withColumn("row_no", F.col("row_no").cast("long"))
    return df.withColumn("row_no", F.monotonically_increasing_id() + 2)


def read_samples(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Strict sample table: required columns present, any unreadable timestamp fails the load."""
    rows = require_columns(df, required)
    if isinstance(rows.schema["timestamp"].dataType, T.StringType):
        rows = rows.withColumn("timestamp", to_timestamp(F.col("timestamp")))
    # a filter on every row: it runs whichever columns are read later, also for a bare count
    failure = F.raise_error(F.lit("invalid timestamp in sample table")).cast("boolean")
    return rows.where(F.when(F.col("timestamp").isNull(), failure).otherwise(F.lit(True)))


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Event documents (JSON lines, evidence in parts) to the event and the evidence table."""
    docs = spark.read.schema(EVENT_SCHEMA).json(path)
    headers = docs.where(F.coalesce("part_no", F.lit(0)) == 0).select(
        "run_id", "event_id", "start", "end", "duration_seconds", "metrics_changed", "severity", "confidence",
        F.col("evidence.anomalous_buckets").alias("anomalous_buckets"), F.col("evidence.bucket_seconds").alias("bucket_seconds"))
    bucket = docs.select("run_id", "event_id", F.explode("evidence.buckets").alias("b"))
    evidence = bucket.select("run_id", "event_id", F.col("b.timestamp").alias("timestamp"),
                             F.explode("b.signals").alias("s")).select("run_id", "event_id", "timestamp", "s.*")
    return headers, evidence


REQUIRED_EVENT = ("run_id", "event_id", "start", "end", "duration_seconds", "metrics_changed", "severity", "confidence", "anomalous_buckets")


def event_problems(headers: DataFrame) -> DataFrame:
    """``headers`` with ``problems``: missing fields, a negative duration, or another event of the same run and id."""
    copies = headers.groupBy("run_id", "event_id").agg(F.count(F.lit(1)).alias("_copies"))
    counted = headers.join(copies.select(F.col("run_id").alias("_run"), F.col("event_id").alias("_event"), "_copies"),
                           F.col("run_id").eqNullSafe(F.col("_run")) & F.col("event_id").eqNullSafe(F.col("_event")))
    found = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED_EVENT]
    found += [F.when(F.col("duration_seconds") < 0, F.lit("negative duration")), F.when(F.col("_copies") > 1, F.lit("duplicate"))]
    return counted.withColumn("problems", F.array_compact(F.array(*found))).drop("_run", "_event", "_copies")


def invalid_events(headers: DataFrame) -> DataFrame:
    """Events that may not be analysed, with the reasons in ``problems``."""
    return event_problems(headers).where(F.size("problems") > 0)


def require_valid_events(headers: DataFrame) -> DataFrame:
    """``headers``; any invalid event fails the load, whichever columns are read."""
    checked = event_problems(headers)
    failure = F.raise_error(F.concat(F.lit("invalid event: "), F.array_join("problems", ", "))).cast("boolean")
    return checked.where(F.when(F.size("problems") > 0, failure).otherwise(F.lit(True))).drop("problems")


def read_correlations(spark: SparkSession, path: str) -> DataFrame:
    """Correlation documents; a row without ``relation_id`` fails the load."""
    rows = spark.read.schema(CORRELATION_SCHEMA).json(path)
    return rows.withColumn("relation_id", F.coalesce("relation_id", F.raise_error(F.lit("correlation without relation_id"))
                                                     .cast("string")))


def read_run_configs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run configuration documents to the run dimension, one row per run."""
    docs = spark.read.schema(CONFIG_SCHEMA).json(path, multiLine=multi_line)
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return docs.select(
        F.trim("run.run_id").alias("run_id"), F.trim("interface.name").alias("expected_interface"),
        positive("interface.capacity_mbps").alias("capacity_mbps"), F.col("run.duration_seconds").alias("duration_seconds"),
        F.col("interface.interval_seconds").alias("interface_interval"), F.col("host.interval_seconds").alias("host_interval"),
        F.col("probes.interval_seconds").alias("probe_interval"), F.col("probes.payload_bytes").alias("payload_bytes"),
        F.col("probes.count_per_target").alias("count_per_target"),
        F.greatest(F.size("targets"), F.lit(1)).alias("target_count"),
        F.transform("targets", lambda t: t["name"]).alias("configured_targets"),
        F.get("targets", F.lit(0))["name"].alias("primary_target"))


def run_targets(spark: SparkSession, path: str) -> DataFrame:
    """Configured targets in long form."""
    docs = spark.read.schema(CONFIG_SCHEMA).json(path)
    return docs.select(F.trim("run.run_id").alias("run_id"), F.explode_outer("targets").alias("t")).select(
        "run_id", F.trim("t.name").alias("target"), "t.address",
        F.coalesce(F.when(F.trim("t.role") != "", F.trim("t.role")), F.lit("unspecified")).alias("role"))


def run_of(path: Column) -> Column:
    """The run id in a file's plain (not URL-encoded) path; folder names are escaped with ``%xx`` when they are written."""
    return url_decoded(F.regexp_extract(path, r"/run_id=([^/]+)/", 1))


def url_decoded(text: Column) -> Column:
    """``%xx`` decoded; a plus sign stays, a percent sign without two digits too."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept)


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifest lines with their run; ``line_no`` grows along each file."""
    lines = spark.read.text(root, recursiveFileLookup=True)
    return lines.where(F.col("value") != "").select(
        run_of(url_decoded(F.col("_metadata.file_path"))).alias("run_id"),
        (F.monotonically_increasing_id() + 1).alias("line_no"), F.col("value").alias("line"))


def pseudonymize_hosts(df: DataFrame, host: str = "hostname", address: str | None = None) -> DataFrame:
    """Salted host hash per run; address replaced by its hash, both raw values dropped."""
    out = df.withColumn(f"{host}_sha256", F.sha2(F.concat(F.col("run_id"), F.lit("\0"), F.col(host)), 256)).drop(host)
    return out if address is None else out.withColumn(f"{address}_sha256", F.sha2(F.col(address), 256)).drop(address)
