"""Per-link capacity, trend, load quality, alerts and ranking over long history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.config import HistoryConfig
from linklens.functions.scalars import capacity_step, rank_in, seconds_between, shown
from linklens.operators.ordered import row_numbers, time_chunk
from linklens.operators.quantiles import exact_quantiles, quantile_of
from linklens.operators.ranks import spearman
from linklens.session import stage, together

# Status and severity scales, worst first.
STATUS_ORDER = ("CRÍTICO", "ALTO", "MEDIO", "NORMAL")
SEVERITY_ORDER = ("CRÍTICA", "ALTA", "MEDIA", "BAJA")
MEDIUM_P95 = 0.60
HIGH_R2, HIGH_R2_DAYS = 0.70, 14
MIN_PAIRS, MIN_DISTINCT = 20, 3
TAIL_DAYS = 3


def daily_link(df: DataFrame) -> DataFrame:
    """Per link and day; a day of one link is bounded, so its quantiles sit in the same aggregate."""
    return df.groupBy("link_id", "date").agg(
        F.avg("utilization").alias("daily_mean_utilization"), F.max("traffic_mbps").alias("daily_peak_traffic_mbps"),
        quantile_of("utilization", 0.95).alias("daily_p95_utilization"),
        quantile_of("rx_utilization", 0.95).alias("daily_p95_rx_utilization"),
        quantile_of("tx_utilization", 0.95).alias("daily_p95_tx_utilization"),
        quantile_of("capacity_mbps", 0.5).alias("capacity_mbps"))


def hourly_link(df: DataFrame) -> DataFrame:
    keys = ["link_id", "hour"]
    shape = exact_quantiles(df, keys, {
        "p95_utilization": ("utilization", 0.95), "p95_rx_utilization": ("rx_utilization", 0.95),
        "p95_tx_utilization": ("tx_utilization", 0.95)})
    return df.groupBy(*keys).agg(F.avg("utilization").alias("mean_utilization")).join(shape, keys, "left")


def peak_hour(hourly: DataFrame) -> DataFrame:
    """Hour with the highest P95; the earliest of equals."""
    return hourly.groupBy("link_id").agg(
        F.max_by("hour", F.struct("p95_utilization", -F.col("hour"))).alias("peak_hour"))


def tail_mean(daily: DataFrame, days: int = TAIL_DAYS) -> DataFrame:
    """Mean daily P95 of the last ``days`` observed days (one row per link and day comes in)."""
    latest = W.partitionBy("link_id").orderBy(F.col("date").desc())
    return (daily.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= days)
            .groupBy("link_id").agg(F.avg("daily_p95_utilization").alias("current_utilization")))


def link_trend(daily: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    """Least-squares slope of the daily P95, its fit, and days until the critical level."""
    y = F.col("daily_p95_utilization")
    x = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")
    fit = daily.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("observations"), F.regr_slope(y, x).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"), F.regr_syy(y, x).alias("_syy"))
    known = F.col("observations") >= 3
    enough = F.col("observations") >= cfg.minimum_trend_days
    growth = F.col("slope_per_day") * 100
    return (
        fit.join(tail_mean(daily), "link_id")
        .withColumns({
            "slope_per_day": F.when(known, F.col("_slope")),
            "r2": F.when(known, F.when(F.col("_syy") <= 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("_r2")))),
            "current_utilization": F.when(known, F.col("current_utilization"))})
        .withColumn("trend_direction",
                    F.when(~known, "SIN_DATOS").when(growth >= cfg.minimum_growth_pp_per_day, "CRECIENTE")
                    .when(growth <= -cfg.minimum_growth_pp_per_day, "DECRECIENTE").otherwise("ESTABLE"))
        .withColumn("trend_reliable", known & enough & (F.col("r2") >= cfg.minimum_trend_r2)
                    & (F.col("trend_direction") != "ESTABLE"))
        .withColumn("trend_confidence",
                    F.when(~known | ~enough, "INSUFICIENTE")
                    .when((F.col("r2") >= HIGH_R2) & (F.col("observations") >= HIGH_R2_DAYS), "ALTA")
                    .when(F.col("r2") >= cfg.minimum_trend_r2, "MEDIA").otherwise("BAJA"))
        .withColumn("days_to_critical",
                    F.when(F.col("current_utilization") >= cfg.critical_threshold, 0.0)
                    .when(F.col("trend_reliable") & (F.col("trend_direction") == "CRECIENTE")
                          & (F.col("slope_per_day") > 0),
                          F.greatest(F.lit(0.0), (cfg.critical_threshold - F.col("current_utilization"))
                                     / F.col("slope_per_day"))))
        .drop("_slope", "_r2", "_syy"))


def _load_pairs(df: DataFrame) -> DataFrame:
    """``link_id, metric, x, y``: utilization against each quality metric, complete pairs only."""
    return df.selectExpr(
        "link_id", "utilization AS x",
        "stack(2, 'latency', latency_ms, 'loss', packet_loss_pct) AS (metric, y)",
    ).where("x IS NOT NULL AND y IS NOT NULL")


def load_spearman(df: DataFrame) -> DataFrame:
    """``link_id, metric, pair_count, x_distinct, y_distinct, rho``; null rho below the minimum."""
    enough = ((F.col("pair_count") >= MIN_PAIRS) & (F.col("x_distinct") >= MIN_DISTINCT)
              & (F.col("y_distinct") >= MIN_DISTINCT))
    return spearman(_load_pairs(df), ["link_id", "metric"]).withColumn("rho", F.when(enough, F.col("rho")))


def load_cuts(df: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    """Utilization borders of high and low load per link and metric."""
    return exact_quantiles(_load_pairs(df), ["link_id", "metric"], {
        "_high": ("x", cfg.high_load_quantile), "_low": ("x", 1 - cfg.high_load_quantile)})


def load_delta(df: DataFrame, cfg: HistoryConfig = HistoryConfig(), ranked: DataFrame | None = None,
               cuts: DataFrame | None = None) -> DataFrame:
    """``link_id, metric, delta``: mean metric under high load minus under low load; null below the minimum of pairs and of distinct values.

    Pairs and distinct values are counted from the metric's own values; ``ranked`` gives both where the correlation is known.
    """
    keys = ["link_id", "metric"]
    cuts = stage(load_cuts(df, cfg), "cuts") if cuts is None else cuts
    means = _load_pairs(df).join(cuts, keys).groupBy(*keys).agg(
        (F.avg(F.when(F.col("x") >= F.col("_high"), F.col("y")))
         - F.avg(F.when(F.col("x") <= F.col("_low"), F.col("y")))).alias("delta"))
    if ranked is None:
        copies = _load_pairs(df).groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_c"))
        size = copies.groupBy(*keys).agg(F.sum("_c").alias("pair_count"), F.count(F.lit(1)).alias("y_distinct"))
    else:
        size = ranked.select(*keys, "pair_count", "y_distinct")
    enough = (F.col("pair_count") >= MIN_PAIRS) & (F.col("y_distinct") >= MIN_DISTINCT)
    return means.join(size, keys).select(*keys, F.when(enough, F.col("delta")).alias("delta"))


def load_association(df: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    """Both quality metrics side by side, one row per link."""
    keys = ["link_id", "metric"]
    ranked, cuts = together(lambda: stage(load_spearman(df), "load_spearman"), lambda: stage(load_cuts(df, cfg), "cuts"))
    both = ranked.select(*keys, "rho").join(load_delta(df, cfg, ranked, cuts), keys, "left")

    def pick(metric: str, column: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(column)))

    return both.groupBy("link_id").agg(
        pick("latency", "rho").alias("util_latency_spearman"), pick("loss", "rho").alias("util_loss_spearman"),
        pick("latency", "delta").alias("latency_high_vs_low_delta_ms"),
        pick("loss", "delta").alias("loss_high_vs_low_delta_pct"))


def quality_label(cfg: HistoryConfig) -> Column:
    limit = cfg.quality_correlation_threshold
    by_latency, by_loss = F.col("util_latency_spearman"), F.col("util_loss_spearman")
    strong = [F.coalesce((rho >= limit) & (F.col(delta) >= least), F.lit(False)) for rho, delta, least in (
        (by_latency, "latency_high_vs_low_delta_ms", cfg.latency_high_load_delta_ms),
        (by_loss, "loss_high_vs_low_delta_pct", cfg.loss_high_load_delta_pct))]
    return (F.when(strong[0] | strong[1], "FUERTE")
            .when(F.greatest(by_latency, by_loss) >= limit, "MODERADA")
            .when(F.coalesce(by_latency, by_loss).isNull(), "SIN_DATOS").otherwise("NO_CONCLUYENTE"))


def status_label(cfg: HistoryConfig) -> Column:
    p95 = F.col("p95_utilization")
    days = F.when(F.col("trend_reliable"), F.col("days_to_critical"))
    return (F.when((p95 >= cfg.critical_threshold) | (days <= cfg.critical_days), "CRÍTICO")
            .when((p95 >= cfg.warning_threshold) | (days <= cfg.warning_days), "ALTO")
            .when(p95 >= MEDIUM_P95, "MEDIO").otherwise("NORMAL"))


def action_label() -> Column:
    status = F.col("status")
    return (F.when((status == "CRÍTICO") & (F.col("additional_capacity_mbps") > 0), "AMPLIAR: prioridad inmediata")
            .when(status == "CRÍTICO", "REVISAR congestión y shaping: prioridad inmediata")
            .when(status == "ALTO", "PROGRAMAR revisión de capacidad")
            .when(F.col("quality_load_association") == "FUERTE", "INVESTIGAR carga y degradación")
            .when(status == "MEDIO", "SEGUIR semanalmente")
            .otherwise("MANTENER"))


def link_core(df: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    """Everything known per link, utilization as ratios.

    The daily, hourly and association tables are written once: several later
    steps read them, and all are smaller than the samples by orders of magnitude.
    """
    shape = exact_quantiles(df, ["link_id"], {
        "capacity_mbps": ("capacity_mbps", 0.5), "rx_p95_utilization": ("rx_utilization", 0.95),
        "tx_p95_utilization": ("tx_utilization", 0.95), "p95_utilization": ("utilization", 0.95),
        "p99_utilization": ("utilization", 0.99), "_rx_p95": ("rx_mbps", 0.95), "_tx_p95": ("tx_mbps", 0.95),
        "latency_p95_ms": ("latency_ms", 0.95), "packet_loss_p95_pct": ("packet_loss_pct", 0.95)})
    daily, peaks, association, shape = together(
        lambda: stage(daily_link(df), "daily"), lambda: stage(peak_hour(hourly_link(df)), "peaks"),
        lambda: stage(load_association(df, cfg), "association"), lambda: stage(shape, "shape"))
    counts = df.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("date").alias("days_observed"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.avg("utilization").alias("avg_utilization"), F.max("utilization").alias("max_utilization"),
        F.count_if("over_capacity").alias("over_capacity_samples"),
        F.min("availability_pct").alias("availability_min_pct"))
    core = (counts.join(shape, "link_id").join(link_trend(daily, cfg), "link_id")
            .join(peaks, "link_id").join(association, "link_id", "left"))
    receiving = F.col("rx_p95_utilization") >= F.col("tx_p95_utilization")
    return (core
            .withColumn("dominant_direction", F.when(receiving, "RX").otherwise("TX"))
            .withColumn("p95_traffic_mbps", F.when(receiving, F.col("_rx_p95")).otherwise(F.col("_tx_p95")))
            .withColumn("technical_required_capacity_mbps", F.col("p95_traffic_mbps") / cfg.target_utilization)
            .withColumn("recommended_capacity_mbps",
                        F.greatest(F.col("capacity_mbps"), capacity_step(F.col("technical_required_capacity_mbps"))))
            .withColumn("additional_capacity_mbps",
                        F.greatest(F.lit(0.0), F.col("recommended_capacity_mbps") - F.col("capacity_mbps")))
            .withColumn("status", status_label(cfg))
            .withColumn("quality_load_association", quality_label(cfg))
            .withColumn("recommended_action", action_label())
            .drop("_rx_p95", "_tx_p95"))


def summarize(core: DataFrame) -> DataFrame:
    """The per-link report row: ratios shown as percent."""
    def pct(source: str, name: str) -> Column:
        return (F.col(source) * 100).alias(name)

    return core.select(
        "link_id", "status", "samples", "days_observed", "first_timestamp", "last_timestamp", "capacity_mbps",
        "dominant_direction", pct("avg_utilization", "avg_utilization_pct"),
        pct("rx_p95_utilization", "rx_p95_utilization_pct"), pct("tx_p95_utilization", "tx_p95_utilization_pct"),
        pct("p95_utilization", "p95_utilization_pct"), pct("p99_utilization", "p99_utilization_pct"),
        pct("max_utilization", "max_utilization_pct"), "p95_traffic_mbps", "peak_hour", "trend_direction",
        pct("slope_per_day", "trend_pct_points_per_day"), F.col("r2").alias("trend_r2"), "trend_confidence",
        "trend_reliable", pct("current_utilization", "current_daily_p95_pct"), "days_to_critical",
        "technical_required_capacity_mbps", "recommended_capacity_mbps", "additional_capacity_mbps",
        "over_capacity_samples", "latency_p95_ms", "packet_loss_p95_pct", "availability_min_pct",
        "util_latency_spearman", "util_loss_spearman", "latency_high_vs_low_delta_ms",
        "loss_high_vs_low_delta_pct", "quality_load_association", "recommended_action")


def link_summary(df: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    return summarize(link_core(df, cfg))


def link_alerts(core: DataFrame, cfg: HistoryConfig = HistoryConfig()) -> DataFrame:
    """``link_id, severity, type, value, message``: up to seven alerts per link."""
    days, p95 = F.col("days_to_critical"), F.col("p95_utilization")

    def alert(condition: Column, severity: Column, kind: str, value: Column, *words) -> Column:
        text = F.concat(*[w if isinstance(w, Column) else F.lit(w) for w in words])
        return F.when(condition, F.struct(severity.alias("severity"), F.lit(kind).alias("type"),
                                          value.cast("double").alias("value"), text.alias("message")))

    near = F.coalesce(F.col("trend_reliable") & (days > 0) & (days <= cfg.warning_days), F.lit(False))
    rows = [
        alert(p95 >= cfg.warning_threshold, F.when(p95 >= cfg.critical_threshold, "CRÍTICA").otherwise("ALTA"),
              "CAPACIDAD", p95 * 100, "P95 ", shown(p95 * 100, 1), "% (", F.col("dominant_direction"), ")"),
        F.when(near, alert(near, F.when(days <= cfg.critical_days, "CRÍTICA").otherwise("ALTA"), "TENDENCIA", days,
                           "Umbral crítico en ", shown(days, 0), " días (R²=", shown(F.col("r2"), 2), ", confianza ",
                           F.lower("trend_confidence"), ")"))
        .otherwise(alert((F.col("trend_direction") == "CRECIENTE") & ~F.col("trend_reliable"), F.lit("BAJA"),
                         "TENDENCIA", F.lit(None), "Crecimiento sin evidencia suficiente para proyectar")),
        alert(F.col("over_capacity_samples") > 0, F.lit("MEDIA"), "CALIDAD_DATOS", F.col("over_capacity_samples"),
              F.col("over_capacity_samples").cast("string"), " muestras sobre la capacidad nominal"),
        alert(F.col("latency_p95_ms") > cfg.latency_threshold_ms, F.lit("ALTA"), "LATENCIA", F.col("latency_p95_ms"),
              "Latencia P95 ", shown(F.col("latency_p95_ms"), 1), " ms"),
        alert(F.col("packet_loss_p95_pct") > cfg.packet_loss_threshold_pct, F.lit("ALTA"), "PÉRDIDA",
              F.col("packet_loss_p95_pct"), "Pérdida P95 ", shown(F.col("packet_loss_p95_pct"), 2), "%"),
        alert(F.col("availability_min_pct") < cfg.availability_threshold_pct, F.lit("MEDIA"), "DISPONIBILIDAD",
              F.col("availability_min_pct"), "Disponibilidad mínima ", shown(F.col("availability_min_pct"), 2), "%"),
        alert(F.col("quality_load_association") == "FUERTE", F.lit("ALTA"), "CARGA_CALIDAD", F.lit(None),
              "Asociación fuerte entre carga y degradación; no implica causa"),
    ]
    return core.select("link_id", F.explode(F.array_compact(F.array(*rows))).alias("a")).select("link_id", "a.*")


def ranked_links(summary: DataFrame) -> DataFrame:
    return summary.orderBy(rank_in(F.col("status"), STATUS_ORDER), F.col("p95_utilization_pct").desc(), "link_id")


def ranked_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(rank_in(F.col("severity"), SEVERITY_ORDER), "link_id", "type")


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("status").agg(F.count(F.lit(1)).alias("links"))


def systematic_sample(df: DataFrame, step: int = 4) -> DataFrame:
    """Every ``step``-th row with a latency, per link in time order, from the first on."""
    ordered = df.where(F.col("latency_ms").isNotNull()).select(
        "link_id", "timestamp", "row_no", "utilization", "latency_ms")
    numbered = row_numbers(ordered, ["link_id"], ["timestamp", "row_no"], time_chunk(ordered))
    return numbered.where(F.pmod(F.col("_rn") - 1, F.lit(step)) == 0).drop("_rn")


def trend_line(daily: DataFrame, trend: DataFrame) -> DataFrame:
    """Observed and fitted daily P95 in percent, reliable links only."""
    y = F.col("daily_p95_utilization") * 100
    reliable = trend.where("trend_reliable").select("link_id", (F.col("slope_per_day") * 100).alias("_slope"))
    span = daily.groupBy("link_id").agg(F.min("date").alias("_start"), F.avg(y).alias("_mean_y"),
                                        F.avg(F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("_mean_d"))
    line = reliable.join(span, "link_id")
    day = F.datediff("date", "_start")
    mean_x = F.col("_mean_d") - F.datediff("_start", F.lit("1970-01-01").cast("date"))
    return daily.join(line, "link_id").select(
        "link_id", "date", y.alias("observed_pct"),
        (F.col("_mean_y") - F.col("_slope") * mean_x + F.col("_slope") * day).alias("fitted_pct"))


def capacity_plan(core: DataFrame) -> DataFrame:
    """Required, recommended and additional capacity on the commercial ladder."""
    return core.select("link_id", "capacity_mbps", "p95_traffic_mbps", "technical_required_capacity_mbps",
                       "recommended_capacity_mbps", "additional_capacity_mbps")


# --- short-window audit ------------------------------------------------------

def link_audit(df: DataFrame) -> DataFrame:
    """Observed-window summary per link, without any projection."""
    counts = df.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min("timestamp").alias("first_timestamp"),
        F.max("timestamp").alias("last_timestamp"), (F.avg("utilization") * 100).alias("avg_utilization_pct"),
        (F.max("utilization") * 100).alias("max_utilization_pct"), F.min("latency_ms").alias("latency_min_ms"),
        F.max("latency_ms").alias("latency_max_ms"), F.avg("packet_loss_pct").alias("packet_loss_mean_pct"),
        F.max("packet_loss_pct").alias("packet_loss_max_pct"), F.min("availability_pct").alias("availability_min_pct"),
        F.count_if("over_capacity").alias("over_capacity_samples"))
    shape = exact_quantiles(df, ["link_id"], {
        "capacity_mbps": ("capacity_mbps", 0.5), "_rx": ("rx_utilization", 0.95), "_tx": ("tx_utilization", 0.95),
        "_p50": ("utilization", 0.5), "_p95": ("utilization", 0.95), "_p99": ("utilization", 0.99),
        "latency_median_ms": ("latency_ms", 0.5), "latency_p95_ms": ("latency_ms", 0.95),
        "latency_p99_ms": ("latency_ms", 0.99), "packet_loss_p95_pct": ("packet_loss_pct", 0.95)})
    rx, tx = F.coalesce("_rx", F.lit(0.0)), F.coalesce("_tx", F.lit(0.0))
    return (counts.join(shape, "link_id", "left")
            .withColumns({"duration_minutes": seconds_between(F.col("first_timestamp"), F.col("last_timestamp")) / 60.0,
                          "dominant_direction": F.when(rx >= tx, "RX").otherwise("TX"),
                          "p50_utilization_pct": F.col("_p50") * 100, "p95_utilization_pct": F.col("_p95") * 100,
                          "p99_utilization_pct": F.col("_p99") * 100})
            .drop("_rx", "_tx", "_p50", "_p95", "_p99"))


def link_audit_meta(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
                  F.countDistinct("link_id").alias("links"), F.count(F.lit(1)).alias("samples")).withColumns({
        "duration_minutes": seconds_between(F.col("first_timestamp"), F.col("last_timestamp")) / 60.0,
        "mode": F.lit("link-audit"), "scope": F.lit("observed_window_only"),
        "long_term_projections_enabled": F.lit(False)})
