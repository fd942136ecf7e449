"""Ingest, history and link audit."""

from linklens.plans.oracle.base import cte, num, r6, statement

cte("ev", """
SELECT event_id, user_id, ts, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(floor(user_id / 15) AS BIGINT) AS run_no
FROM events""")

cte("hist", """
SELECT event_id AS row_no, concat('link-', CAST(user_id AS VARCHAR)) AS link_id, ts AS "timestamp",
  CAST(greatest(0.0, 60 + value / 5 + CASE user_id % 3 WHEN 0 THEN 2.0 * (EXTRACT(DAY FROM ts) - 1)
       WHEN 1 THEN -1.0 * (EXTRACT(DAY FROM ts) - 1) ELSE 0.0 END) AS DOUBLE) AS rx_mbps,
  CAST(30 + k * 0.6 AS DOUBLE) AS tx_mbps, CAST(125 + 50 * (user_id % 4) AS DOUBLE) AS capacity_mbps,
  CAST(CASE WHEN event_type = 'signup' THEN NULL
       ELSE 10 + value / 10 + CASE WHEN user_id % 2 = 0 THEN 2.0 * EXTRACT(DAY FROM ts) ELSE 0.0 END END AS DOUBLE) AS latency_ms,
  CAST(CASE WHEN event_type = 'error' THEN k / 20.0 ELSE 0.0 END AS DOUBLE) AS packet_loss_pct,
  CAST(100.0 - CASE WHEN event_type = 'error' AND event_id % 11 = 0 THEN 2.5 ELSE 0.0 END AS DOUBLE) AS availability_pct
FROM ev""")

cte("hist_damaged", """
SELECT row_no, CASE WHEN row_no % 109 = 0 THEN '  ' ELSE link_id END AS link_id,
  CASE WHEN row_no % 101 = 0 THEN NULL ELSE "timestamp" END AS "timestamp",
  CASE WHEN row_no % 107 = 0 THEN -1.0 ELSE rx_mbps END AS rx_mbps, tx_mbps,
  CASE WHEN row_no % 103 = 0 THEN 0.0 ELSE capacity_mbps END AS capacity_mbps,
  latency_ms, packet_loss_pct, availability_pct FROM hist""")

cte("hist_raw", """
SELECT * FROM hist_damaged UNION ALL
SELECT * REPLACE (row_no + 10000000 AS row_no) FROM hist_damaged WHERE row_no % 50 = 0""")

cte("hist_checked", """
SELECT *, CASE
  WHEN "timestamp" IS NULL THEN 'timestamp inválido' WHEN trim(link_id) = '' THEN 'link_id vacío'
  WHEN rx_mbps IS NULL OR rx_mbps < 0 THEN 'rx_mbps inválido' WHEN tx_mbps IS NULL OR tx_mbps < 0 THEN 'tx_mbps inválido'
  WHEN capacity_mbps IS NULL OR capacity_mbps <= 0 THEN 'capacity_mbps debe ser > 0'
  WHEN packet_loss_pct < 0 OR packet_loss_pct > 100 THEN 'packet_loss_pct fuera de rango'
  WHEN availability_pct < 0 OR availability_pct > 100 THEN 'availability_pct fuera de rango'
  WHEN latency_ms < 0 THEN 'latency_ms inválido'
  WHEN row_number() OVER (PARTITION BY "timestamp", link_id ORDER BY row_no) > 1
    THEN 'registro duplicado para enlace y timestamp' END AS rejection_reason
FROM hist_raw""")

cte("link_rows", """
SELECT *, rx_mbps / capacity_mbps AS rx_u, tx_mbps / capacity_mbps AS tx_u,
  greatest(rx_mbps, tx_mbps) AS traffic, greatest(rx_mbps / capacity_mbps, tx_mbps / capacity_mbps) AS u,
  CAST("timestamp" AS DATE) AS "date", CAST(EXTRACT(HOUR FROM "timestamp") AS INTEGER) AS "hour"
FROM hist""")

cte("daily_t", """
SELECT link_id, "date", quantile_cont(u, 0.95) AS daily_p95_utilization,
  quantile_cont(rx_u, 0.95) AS daily_p95_rx_utilization, quantile_cont(tx_u, 0.95) AS daily_p95_tx_utilization,
  avg(u) AS daily_mean_utilization, max(traffic) AS daily_peak_traffic_mbps, median(capacity_mbps) AS capacity_mbps
FROM link_rows GROUP BY ALL""")

cte("hourly_t", """
SELECT link_id, "hour", avg(u) AS mean_utilization, quantile_cont(u, 0.95) AS p95_utilization,
  quantile_cont(rx_u, 0.95) AS p95_rx_utilization, quantile_cont(tx_u, 0.95) AS p95_tx_utilization
FROM link_rows GROUP BY ALL""")

cte("peak_t", """
SELECT link_id, "hour" AS peak_hour FROM hourly_t
QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY p95_utilization DESC, "hour") = 1""")

cte("tail_t", """
SELECT link_id, avg(daily_p95_utilization) AS current_utilization FROM (
  SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY "date" DESC) AS rn FROM daily_t) WHERE rn <= 3 GROUP BY link_id""")

cte("fit_t", """
SELECT link_id, count(*) AS observations,
  CASE WHEN count(*) >= 3 THEN regr_slope(daily_p95_utilization, d) END AS slope_per_day,
  CASE WHEN count(*) >= 3 THEN CASE WHEN regr_syy(daily_p95_utilization, d) <= 1e-12 THEN 1.0
       ELSE greatest(0.0, regr_r2(daily_p95_utilization, d)) END END AS r2
FROM (SELECT *, CAST(date_diff('day', DATE '1970-01-01', "date") AS DOUBLE) AS d FROM daily_t) GROUP BY link_id""")

cte("trend_dir", """
SELECT link_id, observations, slope_per_day, r2, CASE WHEN observations >= 3 THEN current_utilization END AS current_utilization,
  CASE WHEN observations < 3 THEN 'SIN_DATOS' WHEN slope_per_day * 100 >= 0.05 THEN 'CRECIENTE'
       WHEN slope_per_day * 100 <= -0.05 THEN 'DECRECIENTE' ELSE 'ESTABLE' END AS trend_direction
FROM fit_t JOIN tail_t USING (link_id)""")

cte("trend_rel", """
SELECT *, coalesce(observations >= 7 AND r2 >= 0.35 AND trend_direction <> 'ESTABLE', FALSE) AS trend_reliable,
  CASE WHEN observations < 7 THEN 'INSUFICIENTE' WHEN r2 >= 0.70 AND observations >= 14 THEN 'ALTA'
       WHEN r2 >= 0.35 THEN 'MEDIA' ELSE 'BAJA' END AS trend_confidence
FROM trend_dir""")

cte("trend_t", """
SELECT *, CASE WHEN current_utilization >= 0.85 THEN 0.0
  WHEN trend_reliable AND trend_direction = 'CRECIENTE' AND slope_per_day > 0
    THEN greatest(0.0, (0.85 - current_utilization) / slope_per_day) END AS days_to_critical
FROM trend_rel""")

cte("load_pairs", """
SELECT link_id, 'latency' AS metric, u AS x, latency_ms AS y FROM link_rows WHERE latency_ms IS NOT NULL
UNION ALL SELECT link_id, 'loss', u, packet_loss_pct FROM link_rows WHERE packet_loss_pct IS NOT NULL""")

cte("load_ranked", """
SELECT *, rank() OVER (PARTITION BY link_id, metric ORDER BY x) + (count(*) OVER (PARTITION BY link_id, metric, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY link_id, metric ORDER BY y) + (count(*) OVER (PARTITION BY link_id, metric, y) - 1) / 2.0 AS ry
FROM load_pairs""")

cte("load_rho", """
SELECT link_id, metric, count(*) AS pair_count, count(DISTINCT x) AS x_distinct, count(DISTINCT y) AS y_distinct,
  CASE WHEN count(*) >= 20 AND count(DISTINCT x) >= 3 AND count(DISTINCT y) >= 3 THEN corr(rx, ry) END AS rho
FROM load_ranked GROUP BY ALL""")

cte("load_cuts", """
SELECT link_id, metric, quantile_cont(x, 0.75) AS hi, quantile_cont(x, 0.25) AS lo FROM load_pairs GROUP BY ALL""")

cte("load_gap", """
SELECT link_id, metric, CASE WHEN count(*) >= 20 AND count(DISTINCT y) >= 3
  THEN avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo) END AS delta
FROM load_pairs JOIN load_cuts USING (link_id, metric) GROUP BY ALL""")

cte("assoc_t", """
SELECT link_id, max(rho) FILTER (metric = 'latency') AS util_latency_spearman, max(rho) FILTER (metric = 'loss') AS util_loss_spearman,
  max(delta) FILTER (metric = 'latency') AS latency_high_vs_low_delta_ms, max(delta) FILTER (metric = 'loss') AS loss_high_vs_low_delta_pct
FROM load_rho JOIN load_gap USING (link_id, metric) GROUP BY link_id""")

cte("link_stats", """
SELECT link_id, count(*) AS samples, count(DISTINCT "date") AS days_observed, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp, median(capacity_mbps) AS capacity_mbps, avg(u) AS avg_u,
  quantile_cont(rx_u, 0.95) AS rx95, quantile_cont(tx_u, 0.95) AS tx95, quantile_cont(u, 0.95) AS p95,
  quantile_cont(u, 0.99) AS p99, max(u) AS max_u, count(*) FILTER (u > 1.0) AS over_capacity_samples,
  CASE WHEN quantile_cont(rx_u, 0.95) >= quantile_cont(tx_u, 0.95) THEN 'RX' ELSE 'TX' END AS dominant_direction,
  CASE WHEN quantile_cont(rx_u, 0.95) >= quantile_cont(tx_u, 0.95) THEN quantile_cont(rx_mbps, 0.95)
       ELSE quantile_cont(tx_mbps, 0.95) END AS p95_traffic_mbps,
  quantile_cont(latency_ms, 0.95) AS latency_p95_ms, quantile_cont(packet_loss_pct, 0.95) AS packet_loss_p95_pct,
  min(availability_pct) AS availability_min_pct
FROM link_rows GROUP BY link_id""")

cte("link_cap", """
SELECT *, greatest(capacity_mbps, CASE WHEN required <= 0 THEN 0.0
  ELSE coalesce(list_min(list_filter([10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 800, 1000, 1500, 2000,
    3000, 5000, 10000, 20000], lambda c: c >= required)), ceil(required / 1000.0) * 1000.0) END) AS recommended
FROM (SELECT *, p95_traffic_mbps / 0.70 AS required FROM link_stats)""")

cte("link_all", """
SELECT c.*, t.* EXCLUDE (link_id), p.peak_hour, a.* EXCLUDE (link_id), recommended - capacity_mbps AS additional,
  CASE WHEN p95 >= 0.85 OR (trend_reliable AND days_to_critical <= 30) THEN 'CRÍTICO'
       WHEN p95 >= 0.75 OR (trend_reliable AND days_to_critical <= 90) THEN 'ALTO'
       WHEN p95 >= 0.60 THEN 'MEDIO' ELSE 'NORMAL' END AS status,
  CASE WHEN coalesce(util_latency_spearman >= 0.35 AND latency_high_vs_low_delta_ms >= 5.0, FALSE)
         OR coalesce(util_loss_spearman >= 0.35 AND loss_high_vs_low_delta_pct >= 0.30, FALSE) THEN 'FUERTE'
       WHEN util_latency_spearman >= 0.35 OR util_loss_spearman >= 0.35 THEN 'MODERADA'
       WHEN util_latency_spearman IS NULL AND util_loss_spearman IS NULL THEN 'SIN_DATOS'
       ELSE 'NO_CONCLUYENTE' END AS quality_load_association
FROM link_cap c JOIN trend_t t USING (link_id) JOIN peak_t p USING (link_id) LEFT JOIN assoc_t a USING (link_id)""")

cte("summary_t", """
SELECT link_id, status, samples, days_observed, first_timestamp, last_timestamp, capacity_mbps, dominant_direction,
  avg_u * 100 AS avg_utilization_pct, rx95 * 100 AS rx_p95_utilization_pct, tx95 * 100 AS tx_p95_utilization_pct,
  p95 * 100 AS p95_utilization_pct, p99 * 100 AS p99_utilization_pct, max_u * 100 AS max_utilization_pct,
  p95_traffic_mbps, peak_hour, trend_direction, slope_per_day * 100 AS trend_pct_points_per_day, r2 AS trend_r2,
  trend_confidence, trend_reliable, current_utilization * 100 AS current_daily_p95_pct, days_to_critical,
  required AS technical_required_capacity_mbps, recommended AS recommended_capacity_mbps,
  additional AS additional_capacity_mbps, over_capacity_samples, latency_p95_ms, packet_loss_p95_pct,
  availability_min_pct, util_latency_spearman, util_loss_spearman, latency_high_vs_low_delta_ms,
  loss_high_vs_low_delta_pct, quality_load_association,
  CASE WHEN status = 'CRÍTICO' AND additional > 0 THEN 'AMPLIAR: prioridad inmediata'
       WHEN status = 'CRÍTICO' THEN 'REVISAR congestión y shaping: prioridad inmediata'
       WHEN status = 'ALTO' THEN 'PROGRAMAR revisión de capacidad'
       WHEN quality_load_association = 'FUERTE' THEN 'INVESTIGAR carga y degradación'
       WHEN status = 'MEDIO' THEN 'SEGUIR semanalmente' ELSE 'MANTENER' END AS recommended_action
FROM link_all""")

SUMMARY_FLOATS = (
    "capacity_mbps avg_utilization_pct rx_p95_utilization_pct tx_p95_utilization_pct p95_utilization_pct "
    "p99_utilization_pct max_utilization_pct p95_traffic_mbps trend_pct_points_per_day trend_r2 current_daily_p95_pct "
    "days_to_critical technical_required_capacity_mbps recommended_capacity_mbps additional_capacity_mbps "
    "latency_p95_ms packet_loss_p95_pct availability_min_pct util_latency_spearman util_loss_spearman "
    "latency_high_vs_low_delta_ms loss_high_vs_low_delta_pct")

cte("alerts_t", f"""
SELECT link_id, CASE WHEN p95 >= 0.85 THEN 'CRÍTICA' ELSE 'ALTA' END AS severity, 'CAPACIDAD' AS type, p95 * 100 AS value,
  'P95 ' || {num('p95 * 100', 1)} || '% (' || dominant_direction || ')' AS message FROM link_all WHERE p95 >= 0.75
UNION ALL
SELECT link_id, CASE WHEN days_to_critical <= 30 THEN 'CRÍTICA' ELSE 'ALTA' END, 'TENDENCIA', days_to_critical,
  'Umbral crítico en ' || {num('days_to_critical', 0)} || ' días (R²=' || {num('r2', 2)} || ', confianza ' || lower(trend_confidence) || ')'
FROM link_all WHERE trend_reliable AND days_to_critical > 0 AND days_to_critical <= 90
UNION ALL
SELECT link_id, 'BAJA', 'TENDENCIA', NULL, 'Crecimiento sin evidencia suficiente para proyectar' FROM link_all
WHERE trend_direction = 'CRECIENTE' AND NOT trend_reliable
UNION ALL
SELECT link_id, 'MEDIA', 'CALIDAD_DATOS', over_capacity_samples,
  CAST(over_capacity_samples AS VARCHAR) || ' muestras sobre la capacidad nominal' FROM link_all WHERE over_capacity_samples > 0
UNION ALL
SELECT link_id, 'ALTA', 'LATENCIA', latency_p95_ms, 'Latencia P95 ' || {num('latency_p95_ms', 1)} || ' ms' FROM link_all
WHERE latency_p95_ms > 80
UNION ALL
SELECT link_id, 'ALTA', 'PÉRDIDA', packet_loss_p95_pct, 'Pérdida P95 ' || {num('packet_loss_p95_pct', 2)} || '%' FROM link_all
WHERE packet_loss_p95_pct > 2
UNION ALL
SELECT link_id, 'MEDIA', 'DISPONIBILIDAD', availability_min_pct,
  'Disponibilidad mínima ' || {num('availability_min_pct', 2)} || '%' FROM link_all WHERE availability_min_pct < 99
UNION ALL
SELECT link_id, 'ALTA', 'CARGA_CALIDAD', NULL, 'Asociación fuerte entre carga y degradación; no implica causa' FROM link_all
WHERE quality_load_association = 'FUERTE'""")

HIST_FLOATS = "rx_mbps tx_mbps capacity_mbps latency_ms packet_loss_pct availability_pct"
for key in ("scan_history", "map_columns"):
    statement(key, f'SELECT row_no, link_id, "timestamp", {r6(HIST_FLOATS)} FROM hist')
statement("validate_rows", f'SELECT row_no, link_id, "timestamp", {r6(HIST_FLOATS)}, rejection_reason FROM hist_checked')
statement("rejected_rows", f"""SELECT row_no, link_id, "timestamp", {r6(HIST_FLOATS)}, rejection_reason FROM hist_checked
WHERE rejection_reason IS NOT NULL""")
statement("accepted_rows", f"""SELECT row_no, trim(link_id) AS link_id, "timestamp", {r6(HIST_FLOATS)} FROM hist_checked
WHERE rejection_reason IS NULL""")
statement("read_back_processed", """SELECT row_no, link_id, "timestamp", round(rx_mbps / capacity_mbps, 6) AS rx_utilization,
  round(tx_mbps / capacity_mbps, 6) AS tx_utilization, round(greatest(rx_mbps / capacity_mbps, tx_mbps / capacity_mbps), 6) AS utilization,
  CAST(EXTRACT(HOUR FROM "timestamp") AS INTEGER) AS "hour" FROM hist""")
statement("derive_utilization", f"""SELECT row_no, trim(link_id) AS link_id, "timestamp", {r6(HIST_FLOATS)},
  round(rx_mbps / capacity_mbps, 6) AS rx_utilization, round(tx_mbps / capacity_mbps, 6) AS tx_utilization,
  round(greatest(rx_mbps, tx_mbps), 6) AS traffic_mbps,
  round(greatest(rx_mbps / capacity_mbps, tx_mbps / capacity_mbps), 6) AS utilization,
  CASE WHEN rx_mbps / capacity_mbps >= tx_mbps / capacity_mbps THEN 'RX' ELSE 'TX' END AS bottleneck_direction,
  greatest(rx_mbps / capacity_mbps, tx_mbps / capacity_mbps) > 1.0 AS over_capacity,
  CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS "date", CAST(EXTRACT(HOUR FROM "timestamp") AS INTEGER) AS "hour"
FROM hist_checked WHERE rejection_reason IS NULL""")
statement("ingest_warnings", """SELECT count(*) AS total_rows, count(*) FILTER (rejection_reason IS NULL) AS accepted_rows,
  count(*) FILTER (rejection_reason IS NOT NULL) AS rejected_rows,
  count(*) FILTER (rejection_reason IS NULL AND greatest(rx_mbps, tx_mbps) > capacity_mbps) AS over_capacity_rows,
  0 AS mapped_columns FROM hist_checked""")
statement("daily_link", f"""SELECT link_id, CAST("date" AS VARCHAR) AS "date", {r6('daily_p95_utilization daily_p95_rx_utilization daily_p95_tx_utilization '
  'daily_mean_utilization daily_peak_traffic_mbps capacity_mbps')} FROM daily_t""")
statement("hourly_link", f"""SELECT link_id, "hour", {r6('mean_utilization p95_utilization p95_rx_utilization p95_tx_utilization')}
FROM hourly_t""")
statement("peak_hour", "SELECT link_id, peak_hour FROM peak_t")
statement("tail_mean", f"SELECT link_id, {r6('current_utilization')} FROM tail_t")
statement("link_trend", f"""SELECT link_id, observations, {r6('slope_per_day r2 current_utilization days_to_critical')},
  trend_direction, trend_reliable, trend_confidence FROM trend_t""")
statement("average_rank", """SELECT link_id, round(x, 9) AS utilization, round(max(rx), 6) AS avg_rank, count(*) AS tie_count
FROM load_ranked WHERE metric = 'loss' GROUP BY link_id, x""")
statement("load_spearman", f"SELECT link_id, metric, pair_count, x_distinct, y_distinct, {r6('rho')} FROM load_rho")
statement("load_delta", f"SELECT link_id, metric, {r6('delta')} FROM load_gap")
summary_select = ("SELECT link_id, status, samples, days_observed, first_timestamp, last_timestamp, dominant_direction, peak_hour, "
                  "trend_direction, trend_confidence, trend_reliable, over_capacity_samples, quality_load_association, "
                  f"recommended_action, {r6(SUMMARY_FLOATS)} FROM summary_t")
statement("link_summary", summary_select)
statement("ranked_links", summary_select + """
ORDER BY CASE status WHEN 'CRÍTICO' THEN 0 WHEN 'ALTO' THEN 1 WHEN 'MEDIO' THEN 2 ELSE 3 END, p95_utilization_pct DESC, link_id""")
statement("link_alerts", "SELECT link_id, severity, type, round(value, 6) AS value, message FROM alerts_t")
statement("ranked_alerts", """SELECT link_id, severity, type, round(value, 6) AS value, message FROM alerts_t
ORDER BY CASE severity WHEN 'CRÍTICA' THEN 0 WHEN 'ALTA' THEN 1 WHEN 'MEDIA' THEN 2 ELSE 3 END, link_id, type""")
statement("status_counts", "SELECT status, count(*) AS links FROM summary_t GROUP BY status")
statement("capacity_ladder", f"""SELECT link_id, {r6('capacity_mbps p95_traffic_mbps technical_required_capacity_mbps '
  'recommended_capacity_mbps additional_capacity_mbps')} FROM summary_t""")
statement("systematic_sample", """SELECT link_id, "timestamp", row_no, round(u, 6) AS utilization, round(latency_ms, 6) AS latency_ms
FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY "timestamp", row_no) AS rn FROM link_rows WHERE latency_ms IS NOT NULL)
WHERE rn % 4 = 1""")
statement("trend_line", """SELECT d.link_id, CAST(d."date" AS VARCHAR) AS "date", round(d.daily_p95_utilization * 100, 6) AS observed_pct,
  round(avg(d.daily_p95_utilization * 100) OVER w + t.slope_per_day * 100 *
    (date_diff('day', DATE '1970-01-01', d."date") - avg(date_diff('day', DATE '1970-01-01', d."date")) OVER w), 6) AS fitted_pct
FROM daily_t d JOIN trend_t t ON d.link_id = t.link_id AND t.trend_reliable WINDOW w AS (PARTITION BY d.link_id)""")
statement("link_audit", """SELECT link_id, count(*) AS samples, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp,
  round(date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 / 60, 6) AS duration_minutes,
  round(median(capacity_mbps), 6) AS capacity_mbps,
  CASE WHEN quantile_cont(rx_u, 0.95) >= quantile_cont(tx_u, 0.95) THEN 'RX' ELSE 'TX' END AS dominant_direction,
  round(avg(u) * 100, 6) AS avg_utilization_pct, round(median(u) * 100, 6) AS p50_utilization_pct,
  round(quantile_cont(u, 0.95) * 100, 6) AS p95_utilization_pct, round(quantile_cont(u, 0.99) * 100, 6) AS p99_utilization_pct,
  round(max(u) * 100, 6) AS max_utilization_pct, round(min(latency_ms), 6) AS latency_min_ms,
  round(median(latency_ms), 6) AS latency_median_ms, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms,
  round(quantile_cont(latency_ms, 0.99), 6) AS latency_p99_ms, round(max(latency_ms), 6) AS latency_max_ms,
  round(avg(packet_loss_pct), 6) AS packet_loss_mean_pct, round(quantile_cont(packet_loss_pct, 0.95), 6) AS packet_loss_p95_pct,
  round(max(packet_loss_pct), 6) AS packet_loss_max_pct, round(min(availability_pct), 6) AS availability_min_pct,
  count(*) FILTER (u > 1.0) AS over_capacity_samples FROM link_rows GROUP BY link_id""")
statement("link_audit_meta", """SELECT min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp,
  count(DISTINCT link_id) AS links, count(*) AS samples,
  round(date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 / 60, 6) AS duration_minutes,
  'link-audit' AS mode, 'observed_window_only' AS scope, FALSE AS long_term_projections_enabled FROM link_rows""")
