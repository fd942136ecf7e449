"""Link-history ingest: column mapping, validation, quarantine, derived features."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions.scalars import number_of, to_timestamp
from linklens.session import stage

# Canonical columns and the header names read as each of them.
REQUIRED = ("timestamp", "link_id", "rx_mbps", "tx_mbps", "capacity_mbps")
OPTIONAL = ("latency_ms", "packet_loss_pct", "availability_pct")
ALIASES = {
    "timestamp": ("timestamp", "fecha", "fecha_hora", "datetime", "date_time", "time", "hora_fecha"),
    "link_id": ("link_id", "enlace", "enlace_id", "link", "interface", "interfaz", "device", "dispositivo"),
    "rx_mbps": ("rx_mbps", "rx", "download_mbps", "down_mbps", "in_mbps", "trafico_rx_mbps", "traffic_in_mbps",
        "entrada_mbps"),
    "tx_mbps": ("tx_mbps", "tx", "upload_mbps", "up_mbps", "out_mbps", "trafico_tx_mbps", "traffic_out_mbps",
        "salida_mbps"),
    "capacity_mbps": ("capacity_mbps", "capacity", "capacidad_mbps", "capacidad", "bandwidth_mbps",
        "ancho_banda_mbps"),
    "latency_ms": ("latency_ms", "latency", "latencia_ms", "latencia", "rtt_ms", "ping_ms"),
    "packet_loss_pct": ("packet_loss_pct", "packet_loss", "loss_pct", "perdida_pct", "perdida_paquetes_pct"),
    "availability_pct": ("availability_pct", "availability", "disponibilidad_pct", "disponibilidad",
        "uptime_pct"),
}
# Rejection reasons, in rule order.
REASONS = {
    "timestamp": "timestamp inválido",
    "link_id": "link_id vacío",
    "rx_mbps": "rx_mbps inválido",
    "tx_mbps": "tx_mbps inválido",
    "capacity_mbps": "capacity_mbps debe ser > 0",
    "packet_loss_pct": "packet_loss_pct fuera de rango",
    "availability_pct": "availability_pct fuera de rango",
    "latency_ms": "latency_ms inválido",
    "duplicate": "registro duplicado para enlace y timestamp",
}
NUMERIC = ("rx_mbps", "tx_mbps", "capacity_mbps", *OPTIONAL)


class SchemaError(ValueError):
    """The table lacks a required column or names one twice."""


def normalize_name(name: str) -> str:
    """Header text without accents, lower case, words joined by ``_``."""
    plain = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", name))
    return "_".join(re.findall(r"[a-z0-9]+", plain.lower()))


def resolve_columns(columns: Iterable[str], mapping: Mapping[str, str] | None = None) -> dict[str, str]:
    """Source header -> canonical name. A manual mapping wins over the aliases."""
    by_alias = {alias: target for target, names in ALIASES.items() for alias in names}
    manual = {}
    for source, target in (mapping or {}).items():
        canonical = normalize_name(target)
        if canonical not in REQUIRED + OPTIONAL:
            raise SchemaError(f"unknown mapping target: {target}")
        manual[normalize_name(source)] = canonical
    resolved: dict[str, str] = {}
    for column in columns:
        name = normalize_name(column)
        target = manual.get(name) or by_alias.get(name) or name
        if target in resolved.values():
            raise SchemaError(f"more than one column reads as {target!r}")
        resolved[column] = target
    return resolved


def map_columns(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(resolve_columns(df.columns, mapping))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def typed(df: DataFrame) -> DataFrame:
    """Text cells to typed cells; a cell that cannot be read is null."""
    require_columns(df, REQUIRED)
    casts = {name: number_of(df, name) for name in NUMERIC if name in df.columns}
    if df.schema["timestamp"].dataType.typeName() not in ("timestamp", "timestamp_ntz", "date"):
        casts["timestamp"] = to_timestamp(F.col("timestamp"))
    return df.withColumns(casts)


def validate_rows(df: DataFrame) -> DataFrame:
    """Adds ``rejection_reason`` (null for accepted rows); the first failing rule names it.

    ``row_no`` carries the file order and must be unique. The duplicate rule
    looks at all rows, rejected ones too: a map-side minimum over three narrow
    columns finds the first row of each repeated pair, and the rows are joined to
    it on the pair. The rows are the left side of that join, so adaptive execution
    splits a pair with many copies.
    """
    rows = typed(df)
    pair = ["timestamp", "link_id"]
    repeated = (rows.where(F.col("timestamp").isNotNull() & F.col("link_id").isNotNull())
                .groupBy(*pair).agg(F.min("row_no").alias("_first"), F.count(F.lit(1)).alias("_copies"))
                .where(F.col("_copies") > 1).drop("_copies"))
    rows = rows.join(repeated, pair, "left")

    def negative(name):
        return F.col(name).isNull() | (F.col(name) < 0)

    def outside(name):
        return (F.col(name) < 0) | (F.col(name) > 100)

    rules = [
        ("timestamp", F.col("timestamp").isNull()),
        ("link_id", F.col("link_id").isNull() | (F.trim("link_id") == "")),
        ("rx_mbps", negative("rx_mbps")),
        ("tx_mbps", negative("tx_mbps")),
        ("capacity_mbps", F.col("capacity_mbps").isNull() | (F.col("capacity_mbps") <= 0)),
    ]
    rules += [(name, outside(name)) for name in ("packet_loss_pct", "availability_pct") if name in df.columns]
    if "latency_ms" in df.columns:
        rules.append(("latency_ms", F.col("latency_ms") < 0))
    rules.append(("duplicate", F.col("row_no") != F.col("_first")))
    reason = F.coalesce(*[F.when(failed, F.lit(REASONS[name])) for name, failed in rules])
    return rows.withColumn("rejection_reason", reason).drop("_first")


def rejected_rows(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("rejection_reason").isNotNull())


def accepted_rows(validated: DataFrame) -> DataFrame:
    return (validated.where(F.col("rejection_reason").isNull()).drop("rejection_reason")
            .withColumn("link_id", F.trim("link_id")))


def derive_utilization(accepted: DataFrame) -> DataFrame:
    """Utilization per direction, the dominant one, over-capacity flag, date and hour."""
    absent = {name: F.lit(None).cast("double") for name in OPTIONAL if name not in accepted.columns}
    return (accepted.withColumns(absent)
            .withColumns({"rx_utilization": F.col("rx_mbps") / F.col("capacity_mbps"),
                          "tx_utilization": F.col("tx_mbps") / F.col("capacity_mbps"),
                          "traffic_mbps": F.greatest("rx_mbps", "tx_mbps"),
                          "date": F.col("timestamp").cast("date"), "hour": F.hour("timestamp")})
            .withColumns({"utilization": F.greatest("rx_utilization", "tx_utilization"),
                          "bottleneck_direction": F.when(F.col("rx_utilization") >= F.col("tx_utilization"), "RX")
                          .otherwise("TX")})
            .withColumn("over_capacity", F.col("utilization") > 1.0))


def ingest_warnings(validated: DataFrame, mapped_columns: int = 0) -> DataFrame:
    """One row of counts: totals, accepted, rejected, over capacity, mapped columns."""
    ok = F.col("rejection_reason").isNull()
    over = ok & (F.greatest("rx_mbps", "tx_mbps") > F.col("capacity_mbps"))
    return validated.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(ok).alias("accepted_rows"),
        F.count_if(~ok).alias("rejected_rows"), F.count_if(over).alias("over_capacity_rows"),
        F.lit(mapped_columns).alias("mapped_columns"))


def ingest(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Raw text table -> accepted rows with derived features."""
    return derive_utilization(accepted_rows(validate_rows(map_columns(df, mapping))))
