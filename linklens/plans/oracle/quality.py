"""Data-quality profile, checks and gate."""

from linklens.plans.oracle.base import cte, r6, statement


def _raw(source: str, table: str, grp: str) -> str:
    base = (f"SELECT run_id, '{source}' AS source, {grp} AS grp, CASE WHEN row_no % 101 = 0 THEN NULL ELSE \"timestamp\" END AS \"timestamp\", "
            f"row_no, sample_status = 'ok' AS ok FROM {table}")
    return f"{base} UNION ALL SELECT * REPLACE (row_no + 10000000 AS row_no) FROM ({base}) WHERE row_no % 50 = 0"


cte("raw_t", " UNION ALL ".join([_raw("interface", "iface_t", "interface"), _raw("host", "host_t", "''"), _raw("probes", "probe_t", "target")]))
cte("clean_t", """
SELECT run_id, 'interface' AS source, interface AS grp, "timestamp", row_no, ok FROM iface_t
UNION ALL SELECT run_id, 'host', '', "timestamp", row_no, sample_status = 'ok' FROM host_t
UNION ALL SELECT run_id, 'probes', target, "timestamp", row_no, sample_status = 'ok' FROM probe_t""")
cte("plan_t", """
SELECT run_id, 'interface' AS source, interface_interval AS interval_seconds,
  CAST(ceil(duration_seconds / interface_interval - 1e-12) AS BIGINT) AS expected_rows FROM runs_t
UNION ALL SELECT run_id, 'host', host_interval, CAST(ceil(duration_seconds / host_interval - 1e-12) AS BIGINT) FROM runs_t
UNION ALL SELECT run_id, 'probes', probe_interval, CAST(ceil(duration_seconds / probe_interval - 1e-12) AS BIGINT) * target_count FROM runs_t""")

statement("expected_samples", f"SELECT run_id, source, expected_rows, {r6('interval_seconds')} FROM plan_t")
statement("experiment_estimate", """SELECT run_id, CAST(sum(expected_rows) FILTER (source = 'interface') AS BIGINT) AS interface_rows,
  CAST(sum(expected_rows) FILTER (source = 'host') AS BIGINT) AS host_rows, CAST(sum(expected_rows) FILTER (source = 'probes') AS BIGINT) AS probes_rows,
  CAST(sum(expected_rows) AS BIGINT) AS total_rows, CAST(sum(expected_rows) FILTER (source = 'probes') * 32 AS BIGINT) AS payload_bytes
FROM plan_t GROUP BY run_id""")
statement("scan_raw_samples", 'SELECT run_id, source, grp, "timestamp", row_no, ok FROM raw_t')


def _profile(prefix: str, table: str) -> None:
    cte(f"{prefix}_order", f"""
SELECT * FROM (SELECT *, lag("timestamp") OVER (PARTITION BY run_id, source, grp ORDER BY row_no) AS p FROM {table}
  WHERE "timestamp" IS NOT NULL) WHERE "timestamp" < p""")
    cte(f"{prefix}_gaps", f"""
SELECT run_id, source, count(*) FILTER (g > interval_seconds * 1.75) AS gaps, max(g) AS max_gap_seconds FROM (
  SELECT run_id, source, date_diff('microsecond', lag("timestamp") OVER (PARTITION BY run_id, source, grp ORDER BY "timestamp", row_no), "timestamp") / 1e6 AS g
  FROM {table} WHERE "timestamp" IS NOT NULL) JOIN plan_t USING (run_id, source) GROUP BY ALL""")
    cte(f"{prefix}_dups", f"""
SELECT run_id, source, count(*) - count(DISTINCT (grp, "timestamp")) AS duplicates FROM {table} WHERE "timestamp" IS NOT NULL GROUP BY ALL""")
    cte(f"{prefix}_ts", f"""
SELECT run_id, source, invalid_timestamps, outside_run_window, first_timestamp, last_timestamp, coalesce(out_of_order, 0) AS out_of_order,
  coalesce(duplicates, 0) AS duplicates, coalesce(gaps, 0) AS gaps, max_gap_seconds
FROM (SELECT run_id, source, count(*) FILTER ("timestamp" IS NULL) AS invalid_timestamps,
    count(*) FILTER ("timestamp" < started - INTERVAL '5 seconds' OR "timestamp" > ended + INTERVAL '5 seconds') AS outside_run_window,
    min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp FROM {table} JOIN runs_t USING (run_id) GROUP BY ALL)
LEFT JOIN (SELECT run_id, source, count(*) AS out_of_order FROM {prefix}_order GROUP BY ALL) USING (run_id, source)
LEFT JOIN {prefix}_dups USING (run_id, source) LEFT JOIN {prefix}_gaps USING (run_id, source)""")
    cte(f"{prefix}_prof", f"""
SELECT run_id, source, interval_seconds, expected_rows, coalesce(actual_rows, 0) AS actual_rows, coalesce(valid_rows, 0) AS valid_rows,
  coalesce(actual_rows - valid_rows, 0) AS error_rows, round_even(coalesce(least(actual_rows, expected_rows) / expected_rows * 100.0, 0), 6) AS coverage_pct,
  round_even(coalesce(valid_rows / actual_rows * 100.0, 0), 6) AS valid_pct, t.* EXCLUDE (run_id, source)
FROM plan_t LEFT JOIN (SELECT run_id, source, count(*) AS actual_rows, count(*) FILTER (ok) AS valid_rows FROM {table} GROUP BY ALL) USING (run_id, source)
LEFT JOIN {prefix}_ts t USING (run_id, source)""")


_profile("raw", "raw_t")
_profile("clean", "clean_t")
TS = ("invalid_timestamps, outside_run_window, first_timestamp, last_timestamp, out_of_order, duplicates, gaps, "
      "round(max_gap_seconds, 6) AS max_gap_seconds")
statement("out_of_order", 'SELECT run_id, source, grp, row_no, "timestamp" FROM raw_order')
statement("gaps", "SELECT run_id, source, gaps, round(max_gap_seconds, 6) AS max_gap_seconds FROM raw_gaps")
statement("duplicate_samples", "SELECT run_id, source, duplicates FROM raw_dups")
statement("timestamp_profile", f"SELECT run_id, source, {TS} FROM raw_ts")
statement("source_profile", f"""SELECT run_id, source, expected_rows, actual_rows, valid_rows, error_rows,
  {r6('interval_seconds coverage_pct valid_pct')}, {TS} FROM raw_prof""")
statement("collector_health", """SELECT run_id, source, count(*) AS rows, count(*) FILTER (NOT ok) AS error_rows, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'completed_with_sample_errors' ELSE 'completed' END AS collector_status
FROM raw_t GROUP BY run_id, source""")

cte("impossible_t", """
SELECT run_id, coalesce(a, 0) AS impossible_interface, coalesce(b, 0) AS impossible_host, coalesce(c, 0) AS impossible_probes,
  coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS impossible_values_total
FROM (SELECT run_id, count(*) FILTER (rx_bytes < 0) + count(*) FILTER (tx_bytes < 0) + count(*) FILTER (rx_drops < 0) + count(*) FILTER (rx_errors < 0)
    + count(*) FILTER (rx_bytes_delta < 0) + count(*) FILTER (tx_bytes_delta < 0) + count(*) FILTER (rx_drops_delta < 0) + count(*) FILTER (rx_errors_delta < 0) AS a
  FROM iface_delta GROUP BY run_id)
FULL JOIN (SELECT run_id, count(*) FILTER (cpu_percent < 0 OR cpu_percent > 100) + count(*) FILTER (memory_percent < 0 OR memory_percent > 100) AS b
  FROM host_t GROUP BY run_id) USING (run_id)
FULL JOIN (SELECT run_id, count(*) FILTER (packets_sent < 0) + count(*) FILTER (packets_received < 0) + count(*) FILTER (packets_received > packets_sent) AS c
  FROM probe_t GROUP BY run_id) USING (run_id)""")
cte("cev_t", """
SELECT run_id, count(*) FILTER (contains(counter_event, 'reset')) AS counter_resets,
  count(*) FILTER (contains(counter_event, 'overflow')) AS counter_overflows FROM iface_delta GROUP BY run_id""")
cte("match_t", """
SELECT run_id, expected_interface, coalesce(n, 0) AS observed_interfaces, seen AS observed_interface,
  coalesce(n = 1 AND seen = expected_interface, FALSE) AS interface_match
FROM runs_t LEFT JOIN (SELECT run_id, count(DISTINCT interface) AS n, min(interface) AS seen FROM iface_t GROUP BY run_id) USING (run_id)""")
cte("facts_t", """
SELECT r.run_id, r.timezone_name, r.integrity_valid, m.* EXCLUDE (run_id), i.* EXCLUDE (run_id), c.* EXCLUDE (run_id), p.* EXCLUDE (run_id),
  coalesce(u.unreachable_probe_rows, 0) AS unreachable_probe_rows
FROM runs_t r JOIN match_t m USING (run_id) JOIN impossible_t i USING (run_id) JOIN cev_t c USING (run_id)
JOIN (SELECT run_id, CAST(sum(expected_rows) AS BIGINT) AS expected_rows_total, CAST(sum(actual_rows) AS BIGINT) AS actual_rows_total,
    CAST(sum(valid_rows) AS BIGINT) AS valid_rows_total, CAST(sum(gaps) AS BIGINT) AS gaps_total, CAST(sum(duplicates) AS BIGINT) AS duplicates_total,
    CAST(sum(out_of_order) AS BIGINT) AS out_of_order_total, CAST(sum(invalid_timestamps) AS BIGINT) AS invalid_timestamps_total
  FROM clean_prof GROUP BY run_id) p USING (run_id)
LEFT JOIN (SELECT run_id, count(*) FILTER (NOT reachability) AS unreachable_probe_rows FROM probe_t GROUP BY run_id) u USING (run_id)""")
cte("checks_t", """
SELECT run_id, source || '.coverage' AS check_id, CASE WHEN coverage_pct < 80 THEN 'FAIL' WHEN coverage_pct < 95 THEN 'WARN' ELSE 'PASS' END AS status,
  coverage_pct < 80 AS blocking, actual_rows || '/' || expected_rows || ' filas' AS detail FROM clean_prof
UNION ALL SELECT run_id, source || '.valid_samples', CASE WHEN valid_pct < 80 THEN 'FAIL' WHEN valid_pct < 95 THEN 'WARN' ELSE 'PASS' END,
  valid_pct < 80, valid_rows || '/' || actual_rows || ' válidas' FROM clean_prof
UNION ALL SELECT run_id, source || '.timestamps', CASE WHEN invalid_timestamps > 0 THEN 'FAIL'
    WHEN out_of_order + duplicates + outside_run_window > 0 THEN 'WARN' ELSE 'PASS' END, invalid_timestamps > 0,
  'inválidos=' || invalid_timestamps || ', fuera_de_orden=' || out_of_order || ', duplicados=' || duplicates || ', fuera_de_ventana=' || outside_run_window FROM clean_prof
UNION ALL SELECT run_id, source || '.gaps', CASE WHEN gaps > 0 THEN 'WARN' ELSE 'PASS' END, FALSE,
  'huecos=' || gaps || '; máximo=' || coalesce(CAST(CAST(round(CAST(round(max_gap_seconds, 9) AS DECIMAL(28,9)), 3) AS DECIMAL(20,3)) AS VARCHAR), 'N/D') FROM clean_prof
UNION ALL SELECT run_id, 'integrity.strict', 'PASS', TRUE, 'SHA-256' FROM facts_t
UNION ALL SELECT run_id, 'interface.expected', CASE WHEN interface_match THEN 'PASS' ELSE 'FAIL' END, TRUE,
  'esperada=' || expected_interface || '; observada=' || coalesce(observed_interface, 'N/D') FROM facts_t
UNION ALL SELECT run_id, 'values.possible', CASE WHEN impossible_values_total > 0 THEN 'FAIL' ELSE 'PASS' END, impossible_values_total > 0,
  'imposibles=' || impossible_values_total FROM facts_t
UNION ALL SELECT run_id, 'interface.counter_resets', CASE WHEN counter_resets > 0 THEN 'WARN' ELSE 'PASS' END, FALSE,
  'resets=' || counter_resets || '; overflows=' || counter_overflows FROM facts_t
UNION ALL SELECT run_id, 'probes.reachability', CASE WHEN unreachable_probe_rows > 0 THEN 'WARN' ELSE 'PASS' END, FALSE,
  'no_alcanzables=' || unreachable_probe_rows FROM facts_t
UNION ALL SELECT run_id, 'clock.context', 'PASS', FALSE, 'timezone=UTC' FROM facts_t""")
cte("gate_t", """
SELECT f.*, CASE WHEN bad THEN 'FAIL' WHEN warn THEN 'WARN' ELSE 'PASS' END AS status, NOT bad AS safe_for_conclusions,
  round_even(least(valid_rows_total, expected_rows_total) / expected_rows_total * 100.0, 6) AS temporal_integrity_pct
FROM facts_t f JOIN (SELECT run_id, bool_or(status = 'FAIL') AS bad, bool_or(status = 'WARN') AS warn FROM checks_t GROUP BY run_id) USING (run_id)""")
statement("impossible_values", "SELECT * FROM impossible_t")
statement("counter_events", "SELECT * FROM cev_t")
statement("interface_match", "SELECT * FROM match_t")
statement("quality_checks", "SELECT * FROM checks_t")
statement("quality_gate", """SELECT run_id, status, safe_for_conclusions, expected_rows_total, actual_rows_total, valid_rows_total,
  round(temporal_integrity_pct, 6) AS temporal_integrity_pct, gaps_total, duplicates_total, out_of_order_total, invalid_timestamps_total, counter_resets,
  counter_overflows, impossible_values_total, unreachable_probe_rows, expected_interface, observed_interfaces FROM gate_t""")
