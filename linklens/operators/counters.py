"""Cumulative counters, probe text and delay state turned into per-sample facts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.functions.scalars import seconds_between, status_ok, to_bool
from linklens.operators.ordered import previous_valid, time_chunk

COUNTERS = ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "rx_drops", "tx_drops")
OVERFLOW_SHARE = 0.90  # fixed value: above this share of the maximum a fall is a wrap
RUN_ORDER = ["timestamp", "row_no"]


def _step(name: str, limit: int | None) -> tuple[Column, Column]:
    """Increase of one counter and the kind of step."""
    now, last = F.col(name), F.col(f"_prev.{name}")
    wraps = F.lit(False) if not limit else last > int(limit * OVERFLOW_SHARE)
    delta = F.when(now >= last, now - last)
    if limit:
        delta = delta.when(wraps, F.lit(int(limit)) - last + now + 1)
    kind = F.when(now < last, F.when(wraps, "overflow").otherwise("reset"))
    return delta, kind


def counter_delta(df: DataFrame, maxima: Mapping[str, int] | None = None) -> DataFrame:
    """Adds ``<counter>_delta``, ``counter_event`` and ``elapsed_seconds`` per run and interface.

    The reference point is the last *valid* row, so a failed read neither moves
    it nor produces values of its own.
    """
    maxima = maxima or {}
    names = [c for c in COUNTERS if c in df.columns]
    ok = status_ok(df)
    rows = previous_valid(df.withColumn("sample_ok", ok), ["run_id", "interface"], RUN_ORDER,
                          ["timestamp", *names], F.col("sample_ok"), time_chunk(df))
    steps = {name: _step(name, maxima.get(name)) for name in names}
    seen = F.col("_prev").isNotNull()
    kinds = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[k for _, k in steps.values()])))), "+")
    out = rows.withColumns({f"{name}_delta": F.when(F.col("sample_ok") & seen, delta.cast("long"))
                            for name, (delta, _) in steps.items()})
    return out.withColumns({
        "counter_event": F.when(~F.col("sample_ok"), "unavailable").when(~seen, "initial")
        .when(kinds == "", "normal").otherwise(kinds),
        "elapsed_seconds": F.when(F.col("sample_ok"), seconds_between(F.col("_prev.timestamp"), F.col("timestamp"))),
    }).drop("_prev")


def elapsed_valid(df: DataFrame) -> DataFrame:
    """Adds ``elapsed_seconds`` since the previous valid sample; null on rows in error."""
    rows = previous_valid(df.withColumn("sample_ok", status_ok(df)), ["run_id", "interface"], RUN_ORDER,
                          ["timestamp"], F.col("sample_ok"), time_chunk(df))
    gap = seconds_between(F.col("_prev.timestamp"), F.col("timestamp"))
    return rows.withColumn("elapsed_seconds", F.when(F.col("sample_ok"), gap)).drop("_prev")


def delay_variation(df: DataFrame) -> DataFrame:
    """Adds ``delay_variation_ms``: absolute change against the last known RTT of the target."""
    rows = previous_valid(df, ["run_id", "target"], RUN_ORDER, ["rtt_ms"], F.col("rtt_ms").isNotNull(), time_chunk(df))
    return rows.withColumn("delay_variation_ms", F.abs(F.col("rtt_ms") - F.col("_prev.rtt_ms"))).drop("_prev")


def reachability_transitions(df: DataFrame) -> DataFrame:
    """Rows where a target starts unreachable, goes down or comes back."""
    rows = df.withColumn("_up", to_bool(F.col("reachability")))
    rows = previous_valid(rows, ["run_id", "target"], RUN_ORDER, ["_up"], F.lit(True), time_chunk(df))
    before = F.col("_prev._up")
    change = (F.when(before.isNull() & ~F.col("_up"), "initially_unreachable")
              .when(before & ~F.col("_up"), "became_unreachable").when(~before & F.col("_up"), "recovered"))
    return rows.withColumn("transition", change).where(F.col("transition").isNotNull()).select(
        "run_id", "target", "timestamp", "row_no", "transition")


def error_transitions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows where a source enters or leaves the error state."""
    rows = df.withColumn("_bad", ~status_ok(df))
    rows = previous_valid(rows, keys, RUN_ORDER, ["_bad"], F.lit(True), time_chunk(df))
    before = F.coalesce(F.col("_prev._bad"), F.lit(False))
    change = F.when(F.col("_bad") & ~before, "error_started").when(~F.col("_bad") & before, "recovered")
    return rows.withColumn("transition", change).where(F.col("transition").isNotNull()).select(
        *keys, "timestamp", "row_no", "transition")


# Text patterns of ping output, English and Spanish.
RTT_PATTERN = r"(?i)(?:time|tiempo)\s*([=<])\s*(\d+(?:[.,]\d+)?)\s*ms"
COUNT_PATTERNS = (
    r"packets\s*:\s*sent\s*=\s*(\d+)\s*,\s*received\s*=\s*(\d+)\s*,\s*lost\s*=\s*(\d+)",
    r"paquetes\s*:\s*enviados\s*=\s*(\d+)\s*,\s*recibidos\s*=\s*(\d+)\s*,\s*perdidos\s*=\s*(\d+)",
    r"(\d+)\s+packets?\s+transmitted\s*,\s*(\d+)\s+(?:packets?\s+)?received",
    r"(\d+)\s+paquetes?\s+transmitidos\s*,\s*(\d+)\s+(?:paquetes?\s+)?recibidos",
)
TTL_LINE = r"(?im)^.*?\bttl\s*[=:]\s*\d+\b.*$"
ACCENTED, PLAIN = "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN"


def parse_probe_logs(df: DataFrame) -> DataFrame:
    """Raw ping text (``output``) to packet counts, loss, reachability and RTT figures.

    ``<1 ms`` counts as half a millisecond. Without a readable packet summary
    the replies are the larger of RTT values and TTL lines.
    """
    signs = F.regexp_extract_all("output", F.lit(RTT_PATTERN), F.lit(1))
    raw = F.regexp_extract_all("output", F.lit(RTT_PATTERN), F.lit(2))
    rtts = F.zip_with(signs, raw, lambda sign, text: F.replace(text, F.lit(","), F.lit(".")).cast("double")
                      / F.when(sign == "<", 2.0).otherwise(1.0))
    plain = F.lower(F.translate("output", ACCENTED, PLAIN))

    def summary(group: int) -> Column:
        found = [F.when(plain.rlike(p), F.regexp_extract(plain, p, group).try_cast("long")) for p in COUNT_PATTERNS]
        return F.coalesce(*found)

    rows = df.withColumns({"_rtts": F.sort_array(rtts), "_sent": summary(1), "_got": summary(2),
                           "_ttl": F.regexp_count("output", F.lit(TTL_LINE))})
    readable = F.col("_got") <= F.col("_sent")
    sent = F.when(readable & (F.col("_sent") > 0), F.col("_sent")).otherwise(F.col("count_per_target").cast("long"))
    got = F.when(readable, F.col("_got")).otherwise(F.greatest(F.size("_rtts"), F.col("_ttl")).cast("long"))
    n = F.size("_rtts")
    middle = lambda at: F.get("_rtts", at.cast("int"))
    return (rows.withColumns({"packets_sent": sent, "rtt_ms": F.when(
                n > 0, (middle(F.floor((n - 1) / 2)) + middle(F.floor(n / 2))) / 2.0),
                "rtt_min_ms": F.array_min("_rtts"), "rtt_max_ms": F.array_max("_rtts")})
            .withColumn("packets_received", F.least(got, F.col("packets_sent")))
            .withColumns({"packet_loss_pct": (F.col("packets_sent") - F.col("packets_received"))
                          / F.col("packets_sent") * 100.0,
                          "reachability": F.col("packets_received") > 0,
                          "estimated_outbound_payload_bytes": F.col("packets_sent") * F.col("payload_bytes"),
                          "sample_status": F.lit("ok")})
            .drop("_rtts", "_sent", "_got", "_ttl", "output"))
