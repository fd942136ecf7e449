"""Integrity, report, sources, sinks and streams."""

from linklens.plans.oracle.base import STATEMENTS, cte, num, r6, statement

# --- integrity ------------------------------------------------------------------

cte("files_t", "SELECT concat('run-', lang) AS run_id, concat('docs/', doc_id, '.txt') AS path, sha256(text) AS sha256, doc_id FROM documents")
cte("lines_t", """
SELECT run_id, doc_id AS line_no, doc_id, sha256 AS real, path AS file,
  CASE WHEN doc_id % 83 = 0 THEN '../' || path WHEN doc_id % 71 = 0 THEN 'docs/x/../../' || path
       WHEN doc_id % 67 = 0 THEN 'gone/' || path ELSE path END AS path,
  CASE WHEN doc_id % 97 = 0 THEN 'zz' WHEN doc_id % 89 = 0 THEN sha256('other') ELSE sha256 END AS sha256
FROM files_t WHERE doc_id % 61 <> 0""")
cte("entries_t", """
SELECT *, CASE WHEN sha256 = 'zz' THEN 'malformed' WHEN line_no >= 10000000 THEN 'duplicate' WHEN starts_with(path, '../') THEN 'unsafe'
  ELSE 'ok' END AS entry_status
FROM (SELECT * FROM lines_t UNION ALL SELECT * REPLACE (line_no + 10000000 AS line_no) FROM lines_t WHERE line_no % 79 = 0)""")
cte("untracked_t", """
SELECT run_id, path FROM files_t f WHERE NOT EXISTS (SELECT 1 FROM entries_t e WHERE e.run_id = f.run_id AND e.path = f.path
  AND e.entry_status IN ('ok', 'unsafe'))""")
cte("verified_t", """
SELECT run_id, path, CASE WHEN entry_status IN ('malformed', 'duplicate') THEN 'malformed' WHEN entry_status = 'unsafe' THEN 'unsafe'
  WHEN starts_with(path, 'gone/') THEN 'missing' WHEN sha256 <> real THEN 'mismatched' ELSE 'ok' END AS status FROM entries_t
UNION ALL SELECT run_id, path, 'untracked' FROM untracked_t""")
statement("file_hashes", "SELECT run_id, path, sha256 FROM files_t")
statement("scan_checksum_manifest", """SELECT run_id, line_no, path, sha256, entry_status,
  CASE WHEN entry_status = 'ok' THEN replace(path, 'docs/x/../../', '') END AS target FROM entries_t""")
statement("untracked_files", "SELECT * FROM untracked_t")
statement("verify_manifest", "SELECT * FROM verified_t")
statement("integrity_summary", """SELECT *, ok_files + mismatched_files AS checked_files, TRUE AS strict_untracked,
  missing_files + mismatched_files + malformed_files + unsafe_files + untracked_files = 0 AS integrity_valid FROM (
  SELECT run_id, """ + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_files" for s in (
    "ok", "missing", "mismatched", "malformed", "unsafe", "untracked")) + " FROM verified_t GROUP BY run_id)")

cte("diff_t", """
SELECT 'orders' AS artifact, o_orderkey, c AS "column", 'only_left' AS kind FROM orders,
  (VALUES ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) v(c) WHERE o_orderkey % 211 = 0
UNION ALL SELECT 'orders', o_orderkey, 'o_totalprice', 'changed' FROM orders WHERE o_orderkey % 211 <> 0 AND o_orderkey % 100 = 0
UNION ALL SELECT 'orders', o_orderkey, 'o_orderstatus', 'changed' FROM orders WHERE o_orderkey % 211 <> 0 AND o_orderkey % 150 = 0""")
statement("table_diff", "SELECT * FROM diff_t")
statement("diff_limit", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artifact ORDER BY o_orderkey, "column") AS diff_no FROM diff_t)
WHERE diff_no <= 100""")
statement("cell_type", """SELECT event_id, CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'bool' WHEN 2 THEN 'int' WHEN 3 THEN 'float' ELSE 'text' END AS cell_type FROM ev""")
statement("reproducibility", """SELECT artifact, CAST(0 AS BIGINT) AS difference_count, TRUE AS reproducible
FROM (VALUES ('interface_summary'), ('probe_summary'), ('events'), ('correlations'), ('findings'), ('fingerprints')) v(artifact)
UNION ALL SELECT 'drifted', count(*), count(*) = 0 FROM probe_sum WHERE CAST(substr(run_id, 5) AS INTEGER) % 2 = 1""")
cte("fprof_t", """
SELECT run_id, 'interface_samples' AS file, count(*) AS rows, count(*) FILTER (NOT ok) AS failed_rows, 'sample_status' AS status_source,
  min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp, 'eth0' AS interfaces, '' AS targets FROM iface_t GROUP BY run_id
UNION ALL SELECT run_id, 'host_samples', count(*), NULL, NULL, min("timestamp"), max("timestamp"), '', '' FROM host_t GROUP BY run_id
UNION ALL SELECT run_id, 'probe_samples', count(*), count(*) FILTER (sample_status <> 'ok'), 'sample_status', min("timestamp"), max("timestamp"), '',
  array_to_string(list_sort(list(DISTINCT target)), '|') FROM probe_t GROUP BY run_id""")
statement("file_profile", """SELECT *, round(date_diff('microsecond', first_timestamp, last_timestamp) / 1e6, 6) AS duration_seconds FROM fprof_t""")
cte("rmeta_t", """
SELECT run_id, CAST(sum(rows) AS BIGINT) AS total_rows, CAST(sum(failed_rows) AS BIGINT) AS failed_rows_known_total,
  count(*) FILTER (failed_rows IS NULL) AS failure_status_unknown_files, min(first_timestamp) AS first_timestamp, max(last_timestamp) AS last_timestamp,
  'eth0' AS discovered_interfaces, array_to_string(list_sort(list_distinct(list_concat(
    list_filter(string_split(string_agg(targets, '|'), '|'), lambda t: t <> ''), ['t1', 'ref']))), '|') AS targets, 'eth0' AS interface
FROM fprof_t GROUP BY run_id""")
statement("run_metadata", "SELECT *, round(date_diff('microsecond', first_timestamp, last_timestamp) / 1e6, 6) AS duration_seconds FROM rmeta_t")
statement("known_targets", "SELECT run_id, targets FROM rmeta_t")

# --- report ---------------------------------------------------------------------

cte("head_t", """
SELECT r.run_id, r.primary_target, i.* EXCLUDE (run_id), p.* EXCLUDE (run_id), coalesce(e.event_count, 0) AS event_count
FROM runs_t r
LEFT JOIN (SELECT run_id, avg(utilization_pct) AS utilization_mean_pct, quantile_cont(utilization_pct, 0.95) AS utilization_p95_pct,
    max(utilization_pct) AS utilization_max_pct, CAST(coalesce(sum(rx_drops_delta), 0) AS BIGINT) AS rx_drops_delta_total,
    CAST(0 AS BIGINT) AS tx_drops_delta_total FROM iface_p GROUP BY run_id) i USING (run_id)
LEFT JOIN (SELECT run_id, target AS headline_target, availability_observed_pct, rtt_median_ms, rtt_p95_ms, rtt_p99_ms, loss_percent,
    delay_variation_p95_ms FROM probe_sum QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY target <> 't1', target) = 1) p USING (run_id)
LEFT JOIN (SELECT run_id, count(*) AS event_count FROM events_t GROUP BY run_id) e USING (run_id)""")
statement("headline_metrics", f"""SELECT run_id, primary_target, headline_target, rx_drops_delta_total, tx_drops_delta_total, event_count,
  {r6('utilization_mean_pct utilization_p95_pct utilization_max_pct availability_observed_pct rtt_median_ms rtt_p95_ms rtt_p99_ms loss_percent '
  'delay_variation_p95_ms')} FROM head_t""")
statement("findings_events", """SELECT run_id, finding_id, event_id, CASE WHEN confidence = 'ALTA' AND pl > 0 THEN 'ALTA'
    WHEN confidence IN ('ALTA', 'MEDIA') THEN 'MEDIA' ELSE 'BAJA' END AS confidence,
  severity AS event_severity, confidence AS event_confidence, max_metrics AS event_max_metrics FROM find_t""")
statement("findings_fingerprints", """SELECT run_id, replace(event_id, 'EVENT', 'FINDING') AS finding_id, event_id, fingerprint_id, delta_utilization_pp,
  delta_rtt_pct, delta_delay_variation_pct, delta_loss_pp, delta_drops, round_even((CAST(delta_utilization_pp IS NOT NULL AS INTEGER)
  + CAST(delta_rtt_pct IS NOT NULL AS INTEGER) + CAST(delta_delay_variation_pct IS NOT NULL AS INTEGER) + CAST(delta_loss_pp IS NOT NULL AS INTEGER)
  + CAST(delta_drops IS NOT NULL AS INTEGER)) / 5.0 * 100.0, 3) AS core_completeness_pct FROM fp_t""")
LIMITS = ("Describe únicamente el periodo observado.|La disponibilidad observada no es un SLA.|Correlación y coincidencia no demuestran causalidad."
          "|Lo no disponible se presenta como N/D.|La calidad describe únicamente esta ejecución.|Un target no alcanzable no identifica la causa.")
statement("dedupe_limitations", f"""SELECT run_id, '{LIMITS}' || CASE WHEN safe_for_conclusions THEN '|Spearman mide asociación monotónica.'
  ELSE '' END AS limitations FROM gate_t""")
statement("executive_summary", f"""SELECT run_id, CASE WHEN safe_for_conclusions THEN 'good' ELSE 'note' END AS class,
  'Auditoría de LINK-01 para ACME: ' || {num('2592000 / 3600.0', 2)} || ' horas; ' || valid_rows_total || ' de ' || expected_rows_total
    || ' filas, integridad ' || {num('temporal_integrity_pct', 2)} || '%. ' || CASE WHEN NOT safe_for_conclusions
      THEN 'La calidad del dataset no habilita conclusiones.' WHEN n > 0 THEN event_count || ' eventos y ' || n || ' hallazgos.'
      ELSE event_count || ' eventos, sin hallazgos.' END AS summary,
  CASE WHEN NOT safe_for_conclusions THEN 'Análisis bloqueado hasta corregir la evidencia.'
    WHEN n > 0 THEN 'Hallazgo principal ' || top_id || ': ' || top_fact ELSE 'La ausencia de hallazgos no demuestra ausencia de degradación.' END AS key_message
FROM gate_t g JOIN head_t h USING (run_id) LEFT JOIN (
  SELECT run_id, count(*) AS n, arg_min(finding_id, start) AS top_id, arg_min(event_id || ': ' || CAST(CAST(duration_seconds AS DECIMAL(20,1)) AS VARCHAR)
    || ' s, ' || anomalous_buckets || ' buckets anómalos, métricas: ' || replace(metrics_changed, '|', ', '), start) AS top_fact
  FROM find_t GROUP BY run_id) USING (run_id)""")
cte("series_t", """
SELECT run_id, 'utilization' AS chart, 'utilization' AS series, "timestamp", utilization_pct AS value FROM iface_p
UNION ALL SELECT run_id, 'drops', 'drops', "timestamp", coalesce(rx_drops_delta, 0) FROM iface_p
UNION ALL SELECT run_id, 'rtt', target, "timestamp", rtt_ms FROM probe_p
UNION ALL SELECT run_id, 'delay', target, "timestamp", delay_variation_ms FROM probe_p
UNION ALL SELECT run_id, 'cpu', 'CPU', "timestamp", cpu_percent FROM host_t""")
statement("chart_series", 'SELECT run_id, chart, series, "timestamp", round(value, 6) AS value FROM series_t WHERE value IS NOT NULL')
statement("chart_windows", 'SELECT run_id, min("timestamp") AS global_start, max("timestamp") AS global_end FROM series_t WHERE value IS NOT NULL GROUP BY run_id')
statement("analysis_manifest", """SELECT run_id, CASE WHEN safe_for_conclusions THEN event_count ELSE 0 END AS event_count,
  CASE WHEN safe_for_conclusions THEN event_count ELSE 0 END AS finding_count, CASE WHEN safe_for_conclusions THEN event_count ELSE 0 END AS fingerprint_count,
  18 AS check_count, safe_for_conclusions AS analysis_executed, FALSE AS causal_inference_performed FROM gate_t JOIN head_t USING (run_id)""")
cte("safe_t", "SELECT run_id FROM gate_t WHERE safe_for_conclusions")
cte("sections_t", """
SELECT run_id, section, '' AS item_no FROM runs_t, (VALUES ('run'), ('dataset_quality'), ('executive_summary'), ('limitations')) v(section)
UNION ALL SELECT run_id, 'source', source FROM clean_prof UNION ALL SELECT run_id, 'check', check_id FROM checks_t
UNION ALL SELECT run_id, 'headline_metrics', '' FROM safe_t
UNION ALL SELECT run_id, 'event', event_id FROM events_t JOIN safe_t USING (run_id)
UNION ALL SELECT run_id, 'finding', replace(event_id, 'EVENT', 'FINDING') FROM events_t JOIN safe_t USING (run_id)
UNION ALL SELECT run_id, 'fingerprint', 'FP-' || event_id FROM events_t JOIN safe_t USING (run_id)""")
statement("run_report", "SELECT run_id, section, item_no, TRUE AS valid_payload, 64 AS digest_length FROM sections_t")
statement("pseudonymize_hosts", """SELECT run_id, row_no, sha256(run_id || chr(0) || target) AS hostname_sha256, sha256(address) AS address_sha256 FROM probe_t""")

# --- sources and sinks ------------------------------------------------------------

statement("runs_dim", """SELECT run_id, expected_interface, capacity_mbps, duration_seconds, interface_interval, host_interval, probe_interval,
  32 AS payload_bytes, 10 AS count_per_target, target_count, 't1|t0|t2' AS configured_targets, 't1' AS primary_target FROM runs_t""")
statement("run_targets", """SELECT run_id, target, concat('10.0.0.', substr(target, 2)) AS address,
  CASE WHEN target = 't0' THEN 'internal' ELSE 'unspecified' END AS role FROM runs_t, (VALUES ('t0'), ('t1'), ('t2')) v(target)""")
statement("scan_files_sha256", """SELECT 'run-' || lang AS run_id,
  CASE WHEN doc_id % 7 = 0 THEN '_staging/.old/' WHEN doc_id % 3 = 0 THEN 'docs/' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END
    || 'doc ' || CAST(doc_id AS VARCHAR) || '.txt' AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END) AS sha256
FROM documents""")
statement("invalid_events", """SELECT run_id, event_id, array_to_string(list_filter(['' || CASE WHEN n % 3 = 0 THEN 'missing severity' END,
    CASE WHEN n % 5 = 0 THEN 'negative duration' END, CASE WHEN n % 4 = 0 THEN 'duplicate' END], lambda p: p IS NOT NULL), '|') AS problems
FROM (SELECT *, CAST(substr(event_id, 7) AS INTEGER) AS n FROM events_t), (VALUES (1), (2)) c(copy)
WHERE (n % 3 = 0 OR n % 5 = 0 OR n % 4 = 0) AND (copy = 1 OR n % 4 = 0)""")
for copy, original in (("scan_events_json", "event_evidence"), ("scan_correlations_json", "correlations"), ("read_back_history", "link_summary"),
                       ("read_back_quality", "probe_summary"), ("read_back_events", "events_rollup"), ("read_back_correlations", "correlations"),
                       ("read_back_evidence", "findings")):
    STATEMENTS[copy] = STATEMENTS[original]


def _sizes(key: str, **tables: str) -> None:
    statement(key, " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS rows FROM {source}" for name, source in tables.items()))


_sizes("write_history", summary="summary_t", alerts="alerts_t", daily="daily_t", hourly="hourly_t", processed="link_rows",
       rejected="hist_checked WHERE rejection_reason IS NOT NULL", diagnosis="summary_t")
_sizes("write_link_audit", summary="link_stats", processed="link_rows", manifest="(SELECT 1)")
_sizes("write_quality", interface_summary="(SELECT DISTINCT run_id, interface FROM iface_p)", probe_summary="probe_sum",
       interface_processed="iface_p", probe_processed="probe_p", windows="windows_t")
_sizes("write_events", timeline="line_t", summary="events_t", events="events_t")
_sizes("write_correlations", summary="corr_t", aligned_pairs="(SELECT 1 FROM cp_t JOIN ci_t USING (run_id, bucket) UNION ALL SELECT 1 FROM cp_t JOIN ch_t USING (run_id, bucket))",
       correlations="corr_t")
_sizes("write_evidence", summary="find_t", findings="find_t",
       trace="(SELECT run_id FROM find_t UNION ALL SELECT run_id FROM refs_t)")
_sizes("write_fingerprints", summary="fp_t", trace="tr_t", fingerprints="fp_t")
_sizes("write_dataset_quality", sources="clean_prof", checks="checks_t", gate="gate_t")
_sizes("write_report_tables", report="sections_t", manifest="runs_t")
_sizes("write_checksums", checksums="files_t", metadata="rmeta_t")

# --- streams ------------------------------------------------------------------------

statement("stream_ingest", """SELECT run_id, target, row_no, "timestamp", packets_sent, packets_received, reachability AS reachability_bool,
  round(rtt_ms, 6) AS rtt_ms FROM probe_t""")
statement("stream_counter_delta", """SELECT run_id, interface, "timestamp", row_no, rx_bytes_delta, tx_bytes_delta, rx_drops_delta, rx_errors_delta,
  counter_event FROM iface_delta""")
for copy, original in (("stream_delay_variation", "delay_variation"), ("stream_transitions", "reachability_transitions")):
    STATEMENTS[copy] = STATEMENTS[original]
statement("stream_buckets", """SELECT run_id, time_bucket(INTERVAL '3600 seconds', "timestamp", TIMESTAMP '1970-01-01') AS bucket,
  count(*) AS interface_samples, round(max(rx_rate_mbps), 6) AS rx_rate_mbps, round(max(tx_rate_mbps), 6) AS tx_rate_mbps,
  round(max(utilization_pct), 6) AS utilization_pct, round(CAST(sum(coalesce(rx_errors_delta, 0)) AS DOUBLE), 6) AS errors_delta,
  round(CAST(sum(coalesce(rx_drops_delta, 0)) AS DOUBLE), 6) AS drops_delta FROM iface_p WHERE ok GROUP BY ALL""")
statement("stream_probe_buckets", """SELECT run_id, time_bucket(INTERVAL '3600 seconds', "timestamp", TIMESTAMP '1970-01-01') AS bucket, target,
  count(*) AS probe_samples, round(CAST(sum(packets_sent) AS DOUBLE), 6) AS packets_sent, round(CAST(sum(packets_received) AS DOUBLE), 6) AS packets_received,
  bool_and(reachability) AS reachability, round(max(delay_variation_ms), 6) AS delay_variation_ms,
  round(greatest(0, sum(packets_sent) - sum(packets_received)) / sum(packets_sent) * 100.0, 6) AS packet_loss_pct
FROM probe_p WHERE sample_status = 'ok' GROUP BY ALL""")
statement("stream_events", """SELECT run_id, start, "end", round(duration_seconds, 6) AS duration_seconds, metrics_changed, max_metrics, severity, confidence,
  anomalous_buckets FROM events_t""")
statement("stream_dedup", """SELECT DISTINCT "timestamp", link_id, CASE WHEN "timestamp" < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS landing
FROM hist_raw WHERE "timestamp" IS NOT NULL""")
statement("stream_dropped_rows", """SELECT CASE WHEN late THEN 1 ELSE 2 END AS landing, CAST(count(*) AS BIGINT) AS input_rows,
       CAST(count(*) FILTER (WHERE NOT late AND seen <= latest - INTERVAL 1 HOUR) AS BIGINT) AS dropped_by_watermark
FROM (SELECT "timestamp" AS seen, "timestamp" >= TIMESTAMP '2024-01-16' AS late, max("timestamp") OVER () AS latest FROM host_t WHERE "timestamp" IS NOT NULL)
GROUP BY late""")
statement("stream_late_rows", """SELECT run_id, row_no, "timestamp" FROM host_t
WHERE "timestamp" < TIMESTAMP '2024-01-02 23:59:55' OR "timestamp" > TIMESTAMP '2024-01-31 00:00:05'""")
