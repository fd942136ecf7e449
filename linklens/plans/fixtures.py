"""Telemetry views computed from the driver's ``events`` table.

One link per user, one run per fifteen users. Every view reads the whole
table, so its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.operators.ordered import row_chunk, running_sum

# Fixed values of the views.
BUCKET_SECONDS = 3600
MERGE_GAP_SECONDS = 7200
COUNTER_MAX = {"rx_bytes": 4294967295, "tx_bytes": 4294967295}
RUN_START, RUN_END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id", "user_id", "ts", "event_type", "value",
        "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k",
        "CAST(floor(user_id / 15) AS BIGINT) AS run_no")


def _run_id():
    return F.concat(F.lit("run-"), F.lpad(F.col("run_no").cast("string"), 4, "0"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).selectExpr(
        "event_id AS row_no",
        "concat('link-', CAST(user_id AS STRING)) AS link_id",
        "ts AS `timestamp`",
        """CAST(greatest(0.0D, 60 + value / 5 + CASE user_id % 3
             WHEN 0 THEN 2.0D * (EXTRACT(DAY FROM ts) - 1)
             WHEN 1 THEN -1.0D * (EXTRACT(DAY FROM ts) - 1) ELSE 0.0D END) AS DOUBLE) AS rx_mbps""",
        "CAST(30 + k * 0.6D AS DOUBLE) AS tx_mbps",
        "CAST(125 + 50 * (user_id % 4) AS DOUBLE) AS capacity_mbps",
        """CASE WHEN event_type = 'signup' THEN NULL
             ELSE 10 + value / 10 + CASE WHEN user_id % 2 = 0 THEN 2.0D * EXTRACT(DAY FROM ts) ELSE 0.0D END
           END AS latency_ms""",
        "CAST(CASE WHEN event_type = 'error' THEN k / 20.0D ELSE 0.0D END AS DOUBLE) AS packet_loss_pct",
        """CAST(100.0D - CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 2.5D ELSE 0.0D END
             AS DOUBLE) AS availability_pct""")


def history_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text history with damaged cells and repeated rows, for the ingest rules."""
    rows = history(spark, sf_dir)
    text = rows.selectExpr(
        "row_no",
        "CASE WHEN row_no % 109 = 0 THEN '  ' ELSE link_id END AS link_id",
        "CASE WHEN row_no % 101 = 0 THEN 'bad' ELSE CAST(`timestamp` AS STRING) END AS `timestamp`",
        "CASE WHEN row_no % 107 = 0 THEN '-1' ELSE CAST(rx_mbps AS STRING) END AS rx_mbps",
        "CAST(tx_mbps AS STRING) AS tx_mbps",
        "CASE WHEN row_no % 103 = 0 THEN '0' ELSE CAST(capacity_mbps AS STRING) END AS capacity_mbps",
        "CAST(latency_ms AS STRING) AS latency_ms",
        "CAST(packet_loss_pct AS STRING) AS packet_loss_pct",
        "CAST(availability_pct AS STRING) AS availability_pct")
    copies = text.where("row_no % 50 = 0").withColumn("row_no", F.col("row_no") + 10000000)
    return text.unionByName(copies)


def iface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters with a 32-bit wrap; rows in error carry no counters."""
    rows = ev(spark, sf_dir).where(F.col("event_type").isin("click", "view", "purchase"))
    summed = running_sum(rows, ["run_no"], ["event_id"], {
        "rx_cum": F.floor(F.col("value") * 1000000).cast("long"),
        "tx_cum": F.col("k") * 500000,
        "drop_cum": F.when(F.col("k") >= 90, F.col("k") - 89).otherwise(0),
        "err_cum": F.when(F.col("k") == 7, 1).otherwise(0),
    }, row_chunk("event_id"))
    ok = F.col("event_id") % 53 != 0
    return summed.select(
        F.col("event_id").alias("row_no"), _run_id().alias("run_id"), F.lit("eth0").alias("interface"),
        F.col("ts").alias("timestamp"),
        F.when(ok, F.col("rx_cum") % 4294967296).alias("rx_bytes"),
        F.when(ok, F.col("tx_cum") % 4294967296).alias("tx_bytes"),
        F.when(ok, F.col("drop_cum")).alias("rx_drops"),
        F.when(ok, F.col("err_cum")).alias("rx_errors"),
        F.when(ok, "ok").otherwise("error").alias("sample_status"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    failed = F.col("event_type") == "error"
    received = F.when(failed & (F.col("k") >= 95), 0).when(failed, 10 - F.col("k") % 4).otherwise(10)
    target_no = (F.col("user_id") % 3).cast("string")
    return rows.withColumn("_received", received.cast("long")).select(
        F.col("event_id").alias("row_no"), _run_id().alias("run_id"),
        F.concat(F.lit("t"), target_no).alias("target"),
        F.concat(F.lit("10.0.0."), target_no).alias("address"),
        F.col("ts").alias("timestamp"),
        F.lit(10).cast("long").alias("packets_sent"), F.col("_received").alias("packets_received"),
        (F.col("_received") > 0).alias("reachability"),
        F.when(F.col("_received") > 0, F.col("value")).alias("rtt_ms"),
        F.when(F.col("event_id") % 59 == 0, "error").otherwise("ok").alias("sample_status"))


def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev(spark, sf_dir).where(F.col("event_type") == "view").select(
        F.col("event_id").alias("row_no"), _run_id().alias("run_id"), F.col("ts").alias("timestamp"),
        F.col("k").cast("double").alias("cpu_percent"),
        (35 + F.col("k") / 10.0).cast("double").alias("memory_percent"),
        F.lit("ok").alias("sample_status"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: the configuration dimension with its capture window."""
    return ev(spark, sf_dir).select("run_no").distinct().select(
        _run_id().alias("run_id"),
        F.when(F.col("run_no") % 7 == 3, "eth9").otherwise("eth0").alias("expected_interface"),
        F.when(F.col("run_no") % 5 != 4, F.lit(2.0)).alias("capacity_mbps"),
        F.lit(2592000.0).alias("duration_seconds"), F.lit(3600.0).alias("interface_interval"),
        F.lit(10800.0).alias("host_interval"), F.lit(18000.0).alias("probe_interval"),
        F.lit(3).alias("target_count"),
        F.lit(RUN_START).cast("timestamp_ntz").alias("started"),
        F.lit(RUN_END).cast("timestamp_ntz").alias("ended"),
        F.lit("UTC").alias("timezone_name"), F.lit("t1").alias("primary_target"),
        F.lit(True).alias("integrity_valid"))


def probe_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw ping text: Unix and Windows forms, English and Spanish, some without a summary."""
    base = probes(spark, sf_dir)
    rtt = F.round(F.coalesce("rtt_ms", F.lit(0.0)), 2).cast("decimal(12,2)").cast("string")
    reply = F.when(F.col("packets_received") > 0, F.concat(
        F.lit("64 bytes icmp_seq=1 ttl=64 time="), rtt, F.lit(" ms\n64 bytes icmp_seq=2 ttl=64 time<1 ms\n"))).otherwise("")
    reply_es = F.when(F.col("packets_received") > 0, F.concat(
        F.lit("Respuesta: bytes=32 tiempo="), F.replace(rtt, F.lit("."), F.lit(",")), F.lit("ms TTL=64\n"))).otherwise("")
    sent, got = F.col("packets_sent").cast("string"), F.col("packets_received").cast("string")
    style = F.col("row_no") % 4
    text = (F.when(style == 0, F.concat(reply, sent, F.lit(" packets transmitted, "), got, F.lit(" received, x% packet loss")))
            .when(style == 1, F.concat(reply_es, F.lit("Estadísticas\n Paquetes: enviados = "), sent,
                                       F.lit(", recibidos = "), got, F.lit(", perdidos = 0,")))
            .when(style == 2, F.concat(reply, F.lit("Packets: Sent = "), sent, F.lit(", Received = "), got, F.lit(", Lost = 0")))
            .otherwise(reply))
    return base.select("row_no", "run_id", "target", "timestamp", F.lit(10).alias("count_per_target"),
                       F.lit(32).alias("payload_bytes"), text.alias("output"))


def damaged(df: DataFrame) -> DataFrame:
    """Text timestamps, some unreadable, and repeated rows appended at the end of the file."""
    text = df.withColumn("timestamp", F.when(F.col("row_no") % 101 == 0, "bad").otherwise(F.col("timestamp").cast("string")))
    return text.unionByName(text.where(F.col("row_no") % 50 == 0).withColumn("row_no", F.col("row_no") + 10000000))


def in_slices(df: DataFrame, closing: dict | None = None) -> list[DataFrame]:
    """The whole table in two landings, split in time; ``closing`` adds one far row that moves the watermark on."""
    border = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    first, second = df.where(F.col("timestamp") < border), df.where(F.col("timestamp") >= border)
    if closing is None:
        return [first, second]
    last = df.sparkSession.range(1).select(*[
        F.lit(closing.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return [first, second.unionByName(last)]


CLOSING = {"run_id": "closing", "link_id": "closing", "target": "", "timestamp": "2024-03-01 00:00:00", "sample_ok": True,
           "sample_status": "ok"}


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run configuration documents (nested) of every run."""
    target = lambda n: F.struct(F.lit(f"t{n}").alias("name"), F.lit(f"10.0.0.{n}").alias("address"),
                                F.lit("" if n else "internal").alias("role"))
    return runs(spark, sf_dir).select(
        F.struct("run_id", "duration_seconds").alias("run"),
        F.struct(F.col("expected_interface").alias("name"), F.col("interface_interval").alias("interval_seconds"),
                 "capacity_mbps").alias("interface"),
        F.struct(F.col("host_interval").alias("interval_seconds")).alias("host"),
        F.struct(F.col("probe_interval").alias("interval_seconds"), F.lit(1000).alias("timeout_ms"),
                 F.lit(32).alias("payload_bytes"), F.lit(10).alias("count_per_target")).alias("probes"),
        F.array(target(1), target(0), target(2)).alias("targets"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as run files: one run per language, the text is the content."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.concat(F.lit("run-"), F.col("lang")).alias("run_id"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"), "doc_id")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines of the files, some broken in each way the check knows."""
    digest = F.sha2("content", 256)
    n = F.col("doc_id")
    path = (F.when(n % 83 == 0, F.concat(F.lit("../"), F.col("path"))).when(n % 71 == 0, F.concat(F.lit("docs/x/../../"), F.col("path")))
            .when(n % 67 == 0, F.concat(F.lit("gone/"), F.col("path"))).otherwise(F.col("path")))
    line = (F.when(n % 97 == 0, F.concat(F.lit("zz  "), path)).when(n % 89 == 0, F.concat(F.sha2(F.lit("other"), 256), F.lit("  "), path))
            .otherwise(F.concat(F.upper(digest), F.lit("  "), path)))
    rows = files(spark, sf_dir).where(n % 61 != 0).select("run_id", n.alias("line_no"), line.alias("line"))
    return rows.unionByName(rows.where("line_no % 79 = 0").withColumn("line_no", F.col("line_no") + 10000000))


def order_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and a replay of them: tiny drift everywhere, real changes and lost rows in some."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    k = F.col("o_orderkey")
    replay = orders.where(k % 211 != 0).withColumns({
        "o_totalprice": F.col("o_totalprice") * F.when(k % 100 == 0, 1.001).otherwise(1.0000000005),
        "o_orderstatus": F.when(k % 150 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return orders, replay
