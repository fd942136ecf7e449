"""Run audit: quality and events."""

from linklens.plans.oracle.base import cte, r6, statement

cte("runs_t", """
SELECT concat('run-', lpad(CAST(run_no AS VARCHAR), 4, '0')) AS run_id,
  CASE WHEN run_no % 7 = 3 THEN 'eth9' ELSE 'eth0' END AS expected_interface,
  CASE WHEN run_no % 5 = 4 THEN NULL ELSE CAST(2.0 AS DOUBLE) END AS capacity_mbps,
  CAST(2592000 AS DOUBLE) AS duration_seconds, CAST(3600 AS DOUBLE) AS interface_interval,
  CAST(10800 AS DOUBLE) AS host_interval, CAST(18000 AS DOUBLE) AS probe_interval, 3 AS target_count,
  TIMESTAMP '2024-01-01 00:00:00' AS started, TIMESTAMP '2024-01-31 00:00:00' AS ended,
  'UTC' AS timezone_name, 't1' AS primary_target, TRUE AS integrity_valid
FROM (SELECT DISTINCT run_no FROM ev)""")

cte("iface_t", """
SELECT row_no, run_id, 'eth0' AS interface, "timestamp", sample_status = 'ok' AS ok, sample_status,
  CASE WHEN sample_status = 'ok' THEN CAST(rx_cum AS BIGINT) % 4294967296 END AS rx_bytes,
  CASE WHEN sample_status = 'ok' THEN CAST(tx_cum AS BIGINT) % 4294967296 END AS tx_bytes,
  CASE WHEN sample_status = 'ok' THEN CAST(drop_cum AS BIGINT) END AS rx_drops,
  CASE WHEN sample_status = 'ok' THEN CAST(err_cum AS BIGINT) END AS rx_errors
FROM (SELECT event_id AS row_no, concat('run-', lpad(CAST(run_no AS VARCHAR), 4, '0')) AS run_id, ts AS "timestamp",
        SUM(CAST(floor(value * 1000000) AS BIGINT)) OVER w AS rx_cum, SUM(k * 500000) OVER w AS tx_cum,
        SUM(CASE WHEN k >= 90 THEN k - 89 ELSE 0 END) OVER w AS drop_cum, SUM(CASE WHEN k = 7 THEN 1 ELSE 0 END) OVER w AS err_cum,
        CASE WHEN event_id % 53 = 0 THEN 'error' ELSE 'ok' END AS sample_status
      FROM ev WHERE event_type IN ('click', 'view', 'purchase')
      WINDOW w AS (PARTITION BY run_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")

cte("probe_t", """
SELECT row_no, run_id, target, concat('10.0.0.', substr(target, 2)) AS address, "timestamp", CAST(10 AS BIGINT) AS packets_sent,
  CAST(packets_received AS BIGINT) AS packets_received, packets_received > 0 AS reachability,
  CASE WHEN packets_received > 0 THEN rtt END AS rtt_ms, sample_status
FROM (SELECT event_id AS row_no, concat('run-', lpad(CAST(run_no AS VARCHAR), 4, '0')) AS run_id,
        concat('t', CAST(user_id % 3 AS VARCHAR)) AS target, ts AS "timestamp", value AS rtt,
        CASE WHEN event_type = 'error' AND k >= 95 THEN 0 WHEN event_type = 'error' THEN 10 - k % 4 ELSE 10 END AS packets_received,
        CASE WHEN event_id % 59 = 0 THEN 'error' ELSE 'ok' END AS sample_status
      FROM ev WHERE event_type IN ('signup', 'error'))""")

cte("host_t", """
SELECT event_id AS row_no, concat('run-', lpad(CAST(run_no AS VARCHAR), 4, '0')) AS run_id, ts AS "timestamp",
  CAST(k AS DOUBLE) AS cpu_percent, CAST(35 + k / 10.0 AS DOUBLE) AS memory_percent, 'ok' AS sample_status
FROM ev WHERE event_type = 'view'""")

# Valid rows only see valid rows, so an ordinary lag over them is the reference point.
cte("iface_lag", """
SELECT *, lag("timestamp") OVER w AS p_ts, lag(rx_bytes) OVER w AS p_rx, lag(tx_bytes) OVER w AS p_tx,
  lag(rx_drops) OVER w AS p_drops, lag(rx_errors) OVER w AS p_errors
FROM iface_t WHERE ok WINDOW w AS (PARTITION BY run_id, interface ORDER BY "timestamp", row_no)""")

cte("iface_delta", """
SELECT row_no, run_id, interface, "timestamp", ok, p_ts, rx_bytes, tx_bytes, rx_drops, rx_errors, sample_status,
  CASE WHEN rx_bytes >= p_rx THEN rx_bytes - p_rx WHEN p_rx > 3865470565 THEN 4294967295 - p_rx + rx_bytes + 1 END AS rx_bytes_delta,
  CASE WHEN tx_bytes >= p_tx THEN tx_bytes - p_tx WHEN p_tx > 3865470565 THEN 4294967295 - p_tx + tx_bytes + 1 END AS tx_bytes_delta,
  CASE WHEN rx_drops >= p_drops THEN rx_drops - p_drops END AS rx_drops_delta,
  CASE WHEN rx_errors >= p_errors THEN rx_errors - p_errors END AS rx_errors_delta,
  CASE WHEN p_ts IS NULL THEN 'initial' ELSE coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter([
    CASE WHEN rx_bytes < p_rx THEN CASE WHEN p_rx > 3865470565 THEN 'overflow' ELSE 'reset' END END,
    CASE WHEN tx_bytes < p_tx THEN CASE WHEN p_tx > 3865470565 THEN 'overflow' ELSE 'reset' END END,
    CASE WHEN rx_drops < p_drops THEN 'reset' END, CASE WHEN rx_errors < p_errors THEN 'reset' END],
    lambda e: e IS NOT NULL))), '+'), ''), 'normal') END AS counter_event,
  date_diff('microsecond', p_ts, "timestamp") / 1e6 AS elapsed_seconds
FROM iface_lag
UNION ALL SELECT row_no, run_id, interface, "timestamp", ok, NULL, rx_bytes, tx_bytes, rx_drops, rx_errors, sample_status,
  NULL, NULL, NULL, NULL, 'unavailable', NULL FROM iface_t WHERE NOT ok""")

cte("iface_rates", """
SELECT i.*, r.capacity_mbps,
  CASE WHEN ok AND elapsed_seconds > 0 AND rx_bytes_delta >= 0 THEN rx_bytes_delta * 8.0 / elapsed_seconds / 1e6 END AS rx_rate_mbps,
  CASE WHEN ok AND elapsed_seconds > 0 AND tx_bytes_delta >= 0 THEN tx_bytes_delta * 8.0 / elapsed_seconds / 1e6 END AS tx_rate_mbps
FROM iface_delta i JOIN runs_t r USING (run_id)""")

cte("iface_p", """
SELECT *, rx_rate_mbps / capacity_mbps * 100.0 AS rx_utilization_pct, tx_rate_mbps / capacity_mbps * 100.0 AS tx_utilization_pct,
  greatest(rx_rate_mbps / capacity_mbps * 100.0, tx_rate_mbps / capacity_mbps * 100.0) AS utilization_pct FROM iface_rates""")

cte("probe_p", """
SELECT p.*, reachability AS reachability_bool, abs(rtt_ms - prev) AS delay_variation_ms FROM probe_t p
LEFT JOIN (SELECT row_no, lag(rtt_ms) OVER (PARTITION BY run_id, target ORDER BY "timestamp", row_no) AS prev
           FROM probe_t WHERE rtt_ms IS NOT NULL) USING (row_no)""")

IFACE_FLOATS = "elapsed_seconds rx_rate_mbps tx_rate_mbps rx_utilization_pct tx_utilization_pct utilization_pct capacity_mbps"
statement("scan_samples", 'SELECT row_no, run_id, target, "timestamp", packets_sent, packets_received, round(rtt_ms, 6) AS rtt_ms FROM probe_t')
statement("counter_delta", """SELECT row_no, run_id, interface, "timestamp", rx_bytes_delta, tx_bytes_delta, rx_drops_delta, rx_errors_delta,
  counter_event, round(elapsed_seconds, 6) AS elapsed_seconds FROM iface_delta""")
statement("elapsed_valid", 'SELECT row_no, run_id, "timestamp", round(elapsed_seconds, 6) AS elapsed_seconds FROM iface_delta')
statement("delay_variation", 'SELECT row_no, run_id, target, round(delay_variation_ms, 6) AS delay_variation_ms FROM probe_p')
statement("reachability_transitions", """SELECT run_id, target, "timestamp", row_no,
  CASE WHEN before IS NULL THEN 'initially_unreachable' WHEN before THEN 'became_unreachable' ELSE 'recovered' END AS transition
FROM (SELECT *, lag(reachability) OVER (PARTITION BY run_id, target ORDER BY "timestamp", row_no) AS before FROM probe_t)
WHERE (before IS NULL AND NOT reachability) OR before <> reachability""")
statement("error_transitions", """SELECT run_id, interface, "timestamp", row_no, CASE WHEN ok THEN 'recovered' ELSE 'error_started' END AS transition
FROM (SELECT *, coalesce(lag(ok) OVER (PARTITION BY run_id, interface ORDER BY "timestamp", row_no), TRUE) AS before FROM iface_t)
WHERE before <> ok""")
statement("processed_interface", f"""SELECT row_no, run_id, interface, "timestamp", ok AS sample_ok, rx_bytes_delta, tx_bytes_delta,
  rx_drops_delta, rx_errors_delta, counter_event, {r6(IFACE_FLOATS)} FROM iface_p""")
statement("processed_probes", """SELECT row_no, run_id, target, "timestamp", packets_sent, packets_received, reachability_bool,
  round(rtt_ms, 6) AS rtt_ms, round(delay_variation_ms, 6) AS delay_variation_ms FROM probe_p""")
statement("interface_summary", """SELECT run_id, interface, count(*) AS samples, count(*) FILTER (ok) AS valid_samples,
  min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp,
  round(date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6, 6) AS duration_seconds, round(max(capacity_mbps), 6) AS capacity_mbps,
  round(avg(rx_rate_mbps), 6) AS rx_rate_mean_mbps, round(quantile_cont(rx_rate_mbps, 0.95), 6) AS rx_rate_p95_mbps,
  round(max(rx_rate_mbps), 6) AS rx_rate_max_mbps, round(avg(tx_rate_mbps), 6) AS tx_rate_mean_mbps,
  round(quantile_cont(tx_rate_mbps, 0.95), 6) AS tx_rate_p95_mbps, round(max(tx_rate_mbps), 6) AS tx_rate_max_mbps,
  round(avg(utilization_pct), 6) AS utilization_mean_pct, round(quantile_cont(utilization_pct, 0.95), 6) AS utilization_p95_pct,
  round(max(utilization_pct), 6) AS utilization_max_pct, CAST(coalesce(sum(rx_errors_delta), 0) AS BIGINT) AS rx_errors_delta_total,
  CAST(0 AS BIGINT) AS tx_errors_delta_total, CAST(coalesce(sum(rx_drops_delta), 0) AS BIGINT) AS rx_drops_delta_total,
  CAST(0 AS BIGINT) AS tx_drops_delta_total FROM iface_p GROUP BY run_id, interface""")

cte("probe_sum", """
SELECT run_id, target, min_by(address, row_no) AS address, count(*) AS samples, min("timestamp") AS first_timestamp,
  max("timestamp") AS last_timestamp, date_diff('microsecond', min("timestamp"), max("timestamp")) / 1e6 AS duration_seconds,
  CAST(sum(packets_sent) AS BIGINT) AS total_probes, CAST(sum(packets_received) AS BIGINT) AS successful_probes,
  CAST(greatest(0, sum(packets_sent) - sum(packets_received)) AS BIGINT) AS lost_probes,
  greatest(0, sum(packets_sent) - sum(packets_received)) / sum(packets_sent) * 100.0 AS loss_percent,
  avg(CAST(reachability AS INTEGER)) * 100.0 AS availability_observed_pct, min(rtt_ms) AS rtt_min_ms, median(rtt_ms) AS rtt_median_ms,
  quantile_cont(rtt_ms, 0.95) AS rtt_p95_ms, quantile_cont(rtt_ms, 0.99) AS rtt_p99_ms, max(rtt_ms) AS rtt_max_ms,
  median(delay_variation_ms) AS delay_variation_median_ms, quantile_cont(delay_variation_ms, 0.95) AS delay_variation_p95_ms,
  max(delay_variation_ms) AS delay_variation_max_ms FROM probe_p GROUP BY run_id, target""")
statement("probe_summary", f"""SELECT run_id, target, address, samples, first_timestamp, last_timestamp, total_probes, successful_probes,
  lost_probes, {r6('duration_seconds loss_percent availability_observed_pct rtt_min_ms rtt_median_ms rtt_p95_ms rtt_p99_ms rtt_max_ms '
  'delay_variation_median_ms delay_variation_p95_ms delay_variation_max_ms')} FROM probe_sum""")

cte("windows_t", """
SELECT run_id, greatest(i0, p0) AS s, least(i1, p1) AS e, least(i0, p0) AS u0, greatest(i1, p1) AS u1 FROM
 (SELECT run_id, min("timestamp") AS i0, max("timestamp") AS i1 FROM iface_t GROUP BY run_id)
 JOIN (SELECT run_id, min("timestamp") AS p0, max("timestamp") AS p1 FROM probe_t GROUP BY run_id) USING (run_id)""")
statement("source_overlap", """SELECT run_id, e >= s AS overlap_exists, CASE WHEN e >= s THEN s END AS overlap_start,
  CASE WHEN e >= s THEN e END AS overlap_end, round(CASE WHEN e >= s THEN date_diff('microsecond', s, e) / 1e6 ELSE 0 END, 6) AS overlap_seconds,
  u0 AS union_first, u1 AS union_last, round(date_diff('microsecond', u0, u1) / 1e6, 6) AS union_span_seconds FROM windows_t""")

BUCKET = """time_bucket(INTERVAL '3600 seconds', "timestamp", TIMESTAMP '1970-01-01')"""
cte("iface_clip", f"""
SELECT i.*, {BUCKET} AS bucket FROM iface_p i JOIN windows_t w USING (run_id) WHERE ok AND e > s AND "timestamp" BETWEEN s AND e""")
cte("probe_clip", f"""
SELECT p.*, {BUCKET} AS bucket, CASE WHEN packets_sent > 0 THEN greatest(packets_sent - packets_received, 0) / packets_sent * 100.0 END AS sample_loss
FROM probe_p p JOIN windows_t w USING (run_id) WHERE sample_status = 'ok' AND e > s AND "timestamp" BETWEEN s AND e""")
statement("overlap_filter", """SELECT 'interface' AS source, run_id, row_no, "timestamp" FROM iface_clip
UNION ALL SELECT 'probes', run_id, row_no, "timestamp" FROM probe_clip""")
statement("sample_loss_pct", 'SELECT run_id, row_no, target, round(sample_loss, 6) AS sample_loss_pct FROM probe_clip')

cte("ib_t", """
SELECT run_id, bucket, count(*) AS interface_samples, max(rx_rate_mbps) AS rx_rate_mbps, max(tx_rate_mbps) AS tx_rate_mbps,
  max(utilization_pct) AS utilization_pct, CAST(coalesce(sum(rx_errors_delta), 0) AS DOUBLE) AS errors_delta,
  CAST(coalesce(sum(rx_drops_delta), 0) AS DOUBLE) AS drops_delta FROM iface_clip GROUP BY ALL""")
cte("pb_t", """
SELECT run_id, bucket, target, count(*) AS probe_samples, CAST(sum(packets_sent) AS DOUBLE) AS packets_sent,
  CAST(sum(packets_received) AS DOUBLE) AS packets_received,
  greatest(0, sum(packets_sent) - sum(packets_received)) / sum(packets_sent) * 100.0 AS packet_loss_pct,
  bool_and(reachability) AS reachability, median(rtt_ms) AS rtt_ms, max(delay_variation_ms) AS delay_variation_ms
FROM probe_clip GROUP BY ALL""")
cte("ibase_t", """
SELECT run_id, median(utilization_pct) AS b_util, median(rx_rate_mbps) AS b_rx, median(tx_rate_mbps) AS b_tx FROM iface_clip GROUP BY run_id""")
cte("pbase_t", """
SELECT run_id, target, median(rtt_ms) AS b_rtt, median(delay_variation_ms) AS b_delay, median(sample_loss) AS b_loss
FROM probe_clip GROUP BY run_id, target""")
statement("event_iface_buckets", f"""SELECT run_id, bucket, interface_samples,
  {r6('rx_rate_mbps tx_rate_mbps utilization_pct errors_delta drops_delta')} FROM ib_t""")
statement("event_probe_buckets", f"""SELECT run_id, bucket, target, probe_samples, reachability,
  {r6('packets_sent packets_received packet_loss_pct rtt_ms delay_variation_ms')} FROM pb_t""")
statement("baselines", """SELECT run_id, NULL AS target, metric, round(baseline, 6) AS baseline FROM (
  SELECT run_id, unnest(['utilization_pct', 'rx_rate_mbps', 'tx_rate_mbps']) AS metric, unnest([b_util, b_rx, b_tx]) AS baseline FROM ibase_t)
UNION ALL SELECT run_id, target, metric, round(baseline, 6) FROM (
  SELECT run_id, target, unnest(['rtt_ms', 'delay_variation_ms', 'packet_loss_pct']) AS metric, unnest([b_rtt, b_delay, b_loss]) AS baseline FROM pbase_t)""")

cte("sig_t", """
SELECT run_id, bucket, 'utilization' AS metric, NULL AS target, utilization_pct AS observed, b_util AS baseline, 80.0 AS threshold
FROM ib_t JOIN ibase_t USING (run_id) WHERE utilization_pct >= 80 OR utilization_pct - b_util >= 20
UNION ALL SELECT run_id, bucket, 'traffic_rate', 'RX', rx_rate_mbps, b_rx, coalesce(greatest(1.0, b_rx * 1.75, b_rx + 1.0), 1.0)
FROM ib_t JOIN ibase_t USING (run_id) WHERE utilization_pct IS NULL AND rx_rate_mbps >= greatest(1.0, b_rx * 1.75, b_rx + 1.0)
UNION ALL SELECT run_id, bucket, 'traffic_rate', 'TX', tx_rate_mbps, b_tx, coalesce(greatest(1.0, b_tx * 1.75, b_tx + 1.0), 1.0)
FROM ib_t JOIN ibase_t USING (run_id) WHERE utilization_pct IS NULL AND tx_rate_mbps >= greatest(1.0, b_tx * 1.75, b_tx + 1.0)
UNION ALL SELECT run_id, bucket, 'drops', NULL, drops_delta, NULL, 1.0 FROM ib_t WHERE drops_delta >= 1
UNION ALL SELECT run_id, bucket, 'errors', NULL, errors_delta, NULL, 1.0 FROM ib_t WHERE errors_delta >= 1
UNION ALL SELECT run_id, bucket, 'rtt', target, rtt_ms, b_rtt, greatest(0.0, b_rtt * 1.5, b_rtt + 10.0)
FROM pb_t JOIN pbase_t USING (run_id, target) WHERE rtt_ms >= greatest(0.0, b_rtt * 1.5, b_rtt + 10.0)
UNION ALL SELECT run_id, bucket, 'delay_variation', target, delay_variation_ms, b_delay, greatest(10.0, b_delay * 2.0, b_delay)
FROM pb_t JOIN pbase_t USING (run_id, target) WHERE delay_variation_ms >= greatest(10.0, b_delay * 2.0, b_delay)
UNION ALL SELECT run_id, bucket, 'packet_loss', target, packet_loss_pct, b_loss, 1.0
FROM pb_t JOIN pbase_t USING (run_id, target) WHERE packet_loss_pct >= 1.0 OR (packet_loss_pct IS NOT NULL AND NOT reachability)""")

cte("flags_t", "SELECT run_id, bucket, list_sort(list(DISTINCT metric)) AS metrics FROM sig_t GROUP BY ALL")
cte("line_t", """
SELECT run_id, bucket, coalesce(interface_samples, 0) AS interface_samples, coalesce(probe_targets, 0) AS probe_targets,
  utilization_pct, rx_rate_mbps, tx_rate_mbps, coalesce(drops_delta, 0.0) AS drops_delta, coalesce(errors_delta, 0.0) AS errors_delta,
  coalesce(array_to_string(metrics, '|'), '') AS metrics_changed, coalesce(len(metrics), 0) AS metrics_changed_count
FROM ib_t FULL JOIN (SELECT run_id, bucket, count(*) AS probe_targets FROM pb_t GROUP BY ALL) USING (run_id, bucket)
LEFT JOIN flags_t USING (run_id, bucket)""")
cte("sess_t", """
SELECT *, sum(opens) OVER (PARTITION BY run_id ORDER BY bucket) AS event_no FROM (
  SELECT run_id, bucket, metrics_changed, metrics_changed_count,
    CASE WHEN date_diff('second', lag(bucket) OVER (PARTITION BY run_id ORDER BY bucket), bucket) <= 7200 THEN 0 ELSE 1 END AS opens
  FROM line_t WHERE metrics_changed_count >= 2)""")
cte("event_rows", "SELECT *, printf('EVENT-%03d', CAST(event_no AS BIGINT)) AS event_id FROM sess_t")
cte("events_t", """
SELECT *, date_diff('microsecond', start, "end") / 1e6 AS duration_seconds,
  CASE WHEN max_metrics >= 5 THEN 'critical' WHEN max_metrics = 4 THEN 'high' WHEN max_metrics = 3 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN max_metrics >= 4 OR (max_metrics >= 3 AND anomalous_buckets >= 2) THEN 'ALTA'
       WHEN max_metrics >= 3 OR anomalous_buckets >= 2 THEN 'MEDIA' ELSE 'BAJA' END AS confidence
FROM (SELECT run_id, event_id, min(bucket) AS start, max(bucket) + INTERVAL '3600 seconds' AS "end", max(metrics_changed_count) AS max_metrics,
        count(*) AS anomalous_buckets,
        array_to_string(list_sort(list_distinct(flatten(list(string_split(metrics_changed, '|'))))), '|') AS metrics_changed
      FROM event_rows GROUP BY run_id, event_id)""")
cte("evi_t", "SELECT s.*, r.event_id FROM sig_t s JOIN event_rows r USING (run_id, bucket)")
cte("targets_t", """
SELECT DISTINCT run_id, event_id, target FROM evi_t WHERE metric IN ('rtt', 'delay_variation', 'packet_loss')""")

statement("metric_flags", "SELECT run_id, bucket AS \"timestamp\", array_to_string(metrics, '|') AS metrics_changed FROM flags_t")
statement("event_timeline", f"""SELECT run_id, bucket AS "timestamp", interface_samples, probe_targets, metrics_changed, metrics_changed_count,
  metrics_changed_count >= 2 AS event_candidate, {r6('utilization_pct rx_rate_mbps tx_rate_mbps drops_delta errors_delta')} FROM line_t""")
statement("sessionize_events", 'SELECT run_id, bucket AS "timestamp", CAST(event_no AS BIGINT) AS event_no, event_id FROM event_rows')
statement("events_rollup", """SELECT run_id, event_id, start, "end", round(duration_seconds, 6) AS duration_seconds, metrics_changed, max_metrics,
  severity, confidence, anomalous_buckets FROM events_t""")
statement("event_evidence", f'SELECT run_id, event_id, bucket AS "timestamp", metric, target, {r6("observed baseline threshold")} FROM evi_t')
statement("event_targets", "SELECT run_id, event_id, target FROM targets_t")
statement("event_metadata", """SELECT run_id, e > s AS event_detection_executed, coalesce(timeline_buckets, 0) AS timeline_buckets,
  coalesce(candidate_buckets, 0) AS candidate_buckets, coalesce(event_count, 0) AS event_count FROM windows_t
LEFT JOIN (SELECT run_id, count(*) AS timeline_buckets, count(*) FILTER (metrics_changed_count >= 2) AS candidate_buckets FROM line_t GROUP BY run_id) USING (run_id)
LEFT JOIN (SELECT run_id, CAST(max(event_no) AS BIGINT) AS event_count FROM event_rows GROUP BY run_id) USING (run_id)""")

statement("parse_probe_logs", """SELECT row_no, run_id, target, packets_sent, packets_received,
  round(CASE WHEN packets_received = 0 THEN NULL WHEN row_no % 4 = 1 THEN round(rtt_ms, 2) ELSE (round(rtt_ms, 2) + 0.5) / 2 END, 6) AS rtt_ms,
  round(CASE WHEN packets_received > 0 THEN CASE WHEN row_no % 4 = 1 THEN round(rtt_ms, 2) ELSE least(round(rtt_ms, 2), 0.5) END END, 6) AS rtt_min_ms,
  round(CASE WHEN packets_received > 0 THEN CASE WHEN row_no % 4 = 1 THEN round(rtt_ms, 2) ELSE greatest(round(rtt_ms, 2), 0.5) END END, 6) AS rtt_max_ms,
  round((packets_sent - packets_received) / packets_sent * 100.0, 6) AS packet_loss_pct, packets_received > 0 AS reachability,
  packets_sent * 32 AS estimated_outbound_payload_bytes
FROM (SELECT * REPLACE (CASE WHEN row_no % 4 = 3 AND packets_received > 0 THEN 2 ELSE packets_received END AS packets_received) FROM probe_t)""")

# --- correlations ---------------------------------------------------------------

cte("ci_t", f"""
SELECT run_id, {BUCKET} AS bucket, median(utilization_pct) AS utilization_pct, median(rx_rate_mbps) AS rx_rate_mbps,
  median(tx_rate_mbps) AS tx_rate_mbps, CAST(sum(coalesce(rx_drops_delta, 0)) AS DOUBLE) AS drops_delta,
  CAST(sum(coalesce(rx_errors_delta, 0)) AS DOUBLE) AS errors_delta FROM iface_p WHERE ok GROUP BY ALL""")
cte("cp_t", f"""
SELECT run_id, {BUCKET} AS bucket, target, median(rtt_ms) AS rtt_ms, median(delay_variation_ms) AS delay_variation_ms,
  greatest(0, sum(packets_sent) - sum(packets_received)) / sum(packets_sent) * 100.0 AS packet_loss_pct
FROM probe_p WHERE sample_status = 'ok' GROUP BY ALL""")
cte("ch_t", f"SELECT run_id, {BUCKET} AS bucket, median(cpu_percent) AS cpu_percent FROM host_t GROUP BY ALL")
statement("corr_iface_buckets", f"""SELECT run_id, bucket, {r6('utilization_pct rx_rate_mbps tx_rate_mbps drops_delta errors_delta')} FROM ci_t""")
statement("corr_probe_buckets", f"SELECT run_id, bucket, target, {r6('rtt_ms delay_variation_ms packet_loss_pct')} FROM cp_t")
statement("corr_host_buckets", f"SELECT run_id, bucket, {r6('cpu_percent')} FROM ch_t")
NETWORK = r6("rtt_ms delay_variation_ms packet_loss_pct utilization_pct rx_rate_mbps tx_rate_mbps drops_delta errors_delta")
HOST = r6("rtt_ms delay_variation_ms packet_loss_pct cpu_percent")
statement("align_network", f"SELECT run_id, bucket, target, {NETWORK} FROM cp_t JOIN ci_t USING (run_id, bucket)")
statement("align_host", f"SELECT run_id, bucket, target, {HOST} FROM cp_t JOIN ch_t USING (run_id, bucket)")
statement("aligned_pairs", f"""SELECT run_id, bucket, target, {NETWORK}, NULL AS cpu_percent, 'interface_probe' AS source
FROM cp_t JOIN ci_t USING (run_id, bucket)
UNION ALL BY NAME SELECT run_id, bucket, target, {HOST}, 'host_probe' AS source FROM cp_t JOIN ch_t USING (run_id, bucket)""")

cte("pairs_t", """
SELECT run_id, concat('utilization__rtt__', target) AS relation_id, bucket, utilization_pct AS x, rtt_ms AS y FROM cp_t JOIN ci_t USING (run_id, bucket)
UNION ALL SELECT run_id, concat('utilization__delay_variation__', target), bucket, utilization_pct, delay_variation_ms FROM cp_t JOIN ci_t USING (run_id, bucket)
UNION ALL SELECT run_id, concat('utilization__packet_loss__', target), bucket, utilization_pct, packet_loss_pct FROM cp_t JOIN ci_t USING (run_id, bucket)
UNION ALL SELECT run_id, concat('cpu__rtt__', target), bucket, cpu_percent, rtt_ms FROM cp_t JOIN ch_t USING (run_id, bucket)
UNION ALL SELECT run_id, concat('cpu__packet_loss__', target), bucket, cpu_percent, packet_loss_pct FROM cp_t JOIN ch_t USING (run_id, bucket)
UNION ALL SELECT run_id, 'utilization__drops', bucket, utilization_pct, drops_delta FROM ci_t""")
cte("pairs_ranked", """
SELECT *, rank() OVER (PARTITION BY run_id, relation_id ORDER BY x) + (count(*) OVER (PARTITION BY run_id, relation_id, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY run_id, relation_id ORDER BY y) + (count(*) OVER (PARTITION BY run_id, relation_id, y) - 1) / 2.0 AS ry
FROM pairs_t WHERE x IS NOT NULL AND y IS NOT NULL""")
cte("pairs_rho", """
SELECT run_id, relation_id, count(*) AS n, min(bucket) AS f, max(bucket) AS l, count(DISTINCT x) AS dx, count(DISTINCT y) AS dy,
  CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END AS rho FROM pairs_ranked GROUP BY ALL""")
cte("grid_t", """
SELECT run_id, concat(p, '__', target) AS relation_id, x_metric, y_metric, target FROM (SELECT DISTINCT run_id, target FROM cp_t)
CROSS JOIN (VALUES ('utilization__rtt', 'utilization_pct', 'rtt_ms'), ('utilization__delay_variation', 'utilization_pct', 'delay_variation_ms'),
  ('utilization__packet_loss', 'utilization_pct', 'packet_loss_pct'), ('cpu__rtt', 'cpu_percent', 'rtt_ms'),
  ('cpu__packet_loss', 'cpu_percent', 'packet_loss_pct')) v(p, x_metric, y_metric)
UNION ALL SELECT DISTINCT run_id, 'utilization__drops', 'utilization_pct', 'drops_delta', NULL FROM iface_t""")
cte("util_ok", "SELECT run_id, bool_or(utilization_pct IS NOT NULL) AS usable FROM ci_t GROUP BY run_id")
cte("corr_t", """
SELECT *, abs(spearman_rho) AS abs_rho,
  CASE WHEN spearman_rho > 0 THEN 'positive' WHEN spearman_rho < 0 THEN 'negative' WHEN spearman_rho = 0 THEN 'none' ELSE 'N/D' END AS direction,
  CASE WHEN spearman_rho IS NULL THEN 'N/D' WHEN abs(spearman_rho) < 0.2 THEN 'very_weak' WHEN abs(spearman_rho) < 0.4 THEN 'weak'
       WHEN abs(spearman_rho) < 0.6 THEN 'moderate' WHEN abs(spearman_rho) < 0.8 THEN 'strong' ELSE 'very_strong' END AS strength,
  pair_count >= 12 AS sufficient_samples, FALSE AS causal_interpretation_allowed,
  CASE evidence_status WHEN 'insufficient_samples' THEN 'insufficient' WHEN 'weak_association' THEN 'low'
    WHEN 'descriptive_association' THEN 'adequate_descriptive' ELSE 'N/D' END AS descriptive_significance,
  CASE evidence_status WHEN 'unavailable' THEN 'Sin capacidad explícita: utilización N/D.' WHEN 'no_valid_pairs' THEN 'Sin pares válidos.'
    WHEN 'constant_series' THEN 'Serie constante: Spearman no definible.'
    WHEN 'insufficient_samples' THEN CAST(pair_count AS VARCHAR) || ' pares; mínimo 12.'
    WHEN 'weak_association' THEN 'Asociación débil.' ELSE 'Asociación descriptiva; no implica causalidad.' END AS note
FROM (
  SELECT g.run_id, g.relation_id, x_metric, y_metric, target,
    CASE WHEN x_metric = 'utilization_pct' AND NOT usable THEN 0 ELSE coalesce(n, 0) END AS pair_count,
    CASE WHEN x_metric = 'utilization_pct' AND NOT usable THEN NULL ELSE rho END AS spearman_rho, f AS first_timestamp, l AS last_timestamp,
    CASE WHEN x_metric = 'utilization_pct' AND NOT usable THEN 'unavailable' WHEN coalesce(n, 0) = 0 THEN 'no_valid_pairs'
      WHEN dx <= 1 OR dy <= 1 THEN 'constant_series' WHEN n < 12 THEN 'insufficient_samples'
      WHEN abs(rho) < 0.30 THEN 'weak_association' ELSE 'descriptive_association' END AS evidence_status
  FROM grid_t g JOIN util_ok USING (run_id) LEFT JOIN pairs_rho r ON g.run_id = r.run_id AND g.relation_id = r.relation_id)""")
statement("correlations", f"""SELECT run_id, relation_id, x_metric, y_metric, target, pair_count, {r6('spearman_rho abs_rho')}, direction, strength,
  sufficient_samples, evidence_status, descriptive_significance, first_timestamp, last_timestamp, causal_interpretation_allowed, note FROM corr_t""")

# --- evidence -------------------------------------------------------------------

cte("rel_t", """
SELECT e.run_id, e.event_id, c.relation_id, c.target, c.pair_count, c.spearman_rho, c.evidence_status, c.note,
  CASE WHEN x_metric = 'cpu_percent' THEN 'host_context' ELSE 'load_support' END AS kind,
  coalesce(evidence_status = 'descriptive_association' AND sufficient_samples AND abs(spearman_rho) >= 0.60, FALSE) AS supports
FROM events_t e JOIN corr_t c ON e.run_id = c.run_id AND c.last_timestamp >= e.start AND c.first_timestamp <= e."end"
WHERE list_contains(string_split(e.metrics_changed, '|'),
        CASE y_metric WHEN 'rtt_ms' THEN 'rtt' WHEN 'delay_variation_ms' THEN 'delay_variation' WHEN 'packet_loss_pct' THEN 'packet_loss' ELSE 'drops' END)
  AND (x_metric = 'cpu_percent' OR list_contains(string_split(e.metrics_changed, '|'), 'utilization'))
  AND (c.target IS NULL
       OR NOT EXISTS (SELECT 1 FROM targets_t t WHERE t.run_id = e.run_id AND t.event_id = e.event_id)
       OR EXISTS (SELECT 1 FROM targets_t t WHERE t.run_id = e.run_id AND t.event_id = e.event_id AND t.target = c.target))""")
cte("refs_t", """
SELECT *, row_number() OVER (PARTITION BY run_id, event_id, supports ORDER BY CASE WHEN supports AND kind = 'load_support' THEN 0 ELSE 1 END,
  CASE WHEN supports THEN -abs(spearman_rho) ELSE 0 END, relation_id) AS ref_no FROM rel_t QUALIFY ref_no <= 8""")
cte("find_t", f"""
SELECT e.*, replace(e.event_id, 'EVENT', 'FINDING') AS finding_id, coalesce(ns, 0) AS supporting_correlation_count,
  coalesce(nc, 0) AS context_correlation_count, coalesce(pl, 0) AS pl, coalesce(ph, 0) AS ph, names, coalesce(targets, '') AS targets,
  string_split(e.metrics_changed, '|') AS m
FROM events_t e
LEFT JOIN (SELECT run_id, event_id, count(*) FILTER (supports) AS ns, count(*) FILTER (NOT supports) AS nc,
    count(*) FILTER (supports AND spearman_rho > 0 AND kind = 'load_support') AS pl,
    count(*) FILTER (supports AND spearman_rho > 0 AND kind = 'host_context') AS ph,
    array_to_string(list_slice(list(relation_id ORDER BY ref_no) FILTER (supports AND spearman_rho > 0 AND kind = 'load_support'), 1, 3), ', ') AS names
  FROM refs_t GROUP BY run_id, event_id) r USING (run_id, event_id)
LEFT JOIN (SELECT run_id, event_id, string_agg(target, '|' ORDER BY target) AS targets FROM targets_t GROUP BY run_id, event_id) t USING (run_id, event_id)""")
statement("event_correlations", "SELECT run_id, event_id, supports, relation_id, kind, target, round(spearman_rho, 6) AS spearman_rho FROM rel_t")
statement("top_correlations", "SELECT run_id, event_id, supports, relation_id, kind, target, round(spearman_rho, 6) AS spearman_rho, ref_no FROM refs_t")
statement("core_metric_overlap", """SELECT run_id, event_id, list_has_any(m, ['rtt', 'delay_variation', 'packet_loss', 'drops']) AS quality,
  list_has_any(m, ['drops', 'errors']) AS interface, list_has_any(m, ['rtt', 'packet_loss']) AS sensor FROM find_t""")


def _choose(*texts: str) -> str:
    tests = ("list_contains(m, 'utilization') AND list_has_any(m, ['rtt', 'delay_variation', 'packet_loss', 'drops']) AND pl > 0",
             "ph > 0 AND list_has_any(m, ['rtt', 'packet_loss'])", "list_has_any(m, ['drops', 'errors'])",
             "list_contains(m, 'packet_loss')")
    return "CASE " + " ".join(f"WHEN {t} THEN '{x}'" for t, x in zip(tests, texts)) + f" ELSE '{texts[-1]}' END"


statement("findings", f"""SELECT run_id, finding_id, event_id, start, "end", round(duration_seconds, 6) AS duration_seconds, severity, metrics_changed, targets,
  event_id || ': ' || CAST(CAST(round(duration_seconds, 1) AS DECIMAL(20,1)) AS VARCHAR) || ' s, ' || CAST(anomalous_buckets AS VARCHAR)
    || ' buckets anómalos, métricas: ' || array_to_string(m, ', ') AS fact,
  CASE WHEN list_contains(m, 'utilization') AND pl > 0 THEN 'Degradación coincidente con mayor carga; asociaciones positivas fuertes: '
      || names || '. No demuestra causalidad.'
    WHEN len(m) >= 2 THEN 'Degradación simultánea en varias métricas; causa física no determinada.'
    ELSE 'Cambio temporal en una métrica; requiere contexto.' END AS interpretation,
  {_choose('Compatible con colas o cuello de botella bajo carga; requiere confirmación.',
           'Compatible con contribución del host sensor; sin causalidad atribuible.',
           'Posible incidencia en colas, interfaz o camino; requiere telemetría adicional.',
           'Posible degradación del camino o destino; requiere comparación entre targets.',
           'Cambio de causa indeterminada con la evidencia actual.')} AS hypothesis,
  {_choose('Repetir en hora pico y correlacionar con el elemento aguas arriba.',
           'Repetir con captura simultánea de CPU, carga y enlace.',
           'Revisar contadores y colas aguas arriba en una ventana equivalente.',
           'Repetir con targets internos, externos y de referencia.',
           'Extender la ventana y recolectar telemetría relacionada.')} AS recommendation,
  CASE WHEN confidence = 'ALTA' AND pl > 0 THEN 'ALTA' WHEN confidence IN ('ALTA', 'MEDIA') THEN 'MEDIA' ELSE 'BAJA' END AS confidence,
  CASE WHEN confidence = 'ALTA' AND pl > 0 THEN 'Evento ALTA con asociación positiva fuerte de carga.'
    WHEN confidence IN ('ALTA', 'MEDIA') THEN 'Detección suficiente sin soporte correlacional fuerte.' ELSE 'Confianza de detección baja.' END AS confidence_basis,
  confidence AS detector_confidence, anomalous_buckets, supporting_correlation_count, context_correlation_count,
  'El hallazgo describe solo la ventana observada.|Coincidencia y correlación no demuestran causalidad.|La hipótesis requiere confirmación adicional.'
    || CASE WHEN supporting_correlation_count = 0 THEN '|Sin correlación fuerte, suficiente y compatible que eleve la confianza.' ELSE '' END AS limitations,
  FALSE AS causal_claim_allowed FROM find_t""")
statement("evidence_trace", """SELECT run_id, finding_id, 'event' AS source_type, event_id AS source_id, '' AS target, NULL AS pair_count,
  NULL AS spearman_rho, 'event_evidence' AS evidence_status, CAST(anomalous_buckets AS VARCHAR) || ' buckets anómalos' AS note FROM find_t
UNION ALL SELECT run_id, replace(event_id, 'EVENT', 'FINDING'), CASE WHEN supports THEN 'supporting_correlations' ELSE 'context_correlations' END,
  relation_id, coalesce(target, ''), pair_count, round(spearman_rho, 6), evidence_status, note FROM refs_t""")

# --- fingerprints ----------------------------------------------------------------

cte("tr_t", """
SELECT run_id, event_id, concat('FP-', event_id) AS fingerprint_id, bucket AS "timestamp", metric, target, baseline, observed, observed - baseline AS change,
  CASE WHEN metric IN ('rtt', 'delay_variation', 'traffic_rate') THEN CASE WHEN baseline <> 0 THEN (observed - baseline) / baseline * 100.0 END
       WHEN metric IN ('drops', 'errors') THEN observed ELSE observed - baseline END AS delta,
  CASE WHEN metric IN ('rtt', 'delay_variation', 'traffic_rate') THEN '%' WHEN metric IN ('drops', 'errors') THEN 'count' ELSE 'pp' END AS unit
FROM evi_t""")
cte("ext_t", """
SELECT run_id, event_id, metric, target, "timestamp", round_even(baseline, 3) AS baseline, round_even(observed, 3) AS peak,
  round_even(delta, 3) AS delta, CASE WHEN unit = '%' THEN round_even(change, 3) END AS delta_abs
FROM tr_t WHERE metric NOT IN ('drops', 'errors') AND coalesce(delta, CASE WHEN unit = '%' THEN change ELSE observed END) IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY run_id, event_id, metric, target ORDER BY delta IS NOT NULL DESC,
  abs(coalesce(delta, CASE WHEN unit = '%' THEN change ELSE observed END)) DESC, "timestamp") = 1""")
cte("vec_t", """
SELECT run_id, event_id, max(delta) FILTER (metric = 'utilization') AS delta_utilization_pp,
  arg_min({'t': target, 'v': delta}, {'a': -abs(delta), 'b': target}) FILTER (metric = 'rtt' AND delta IS NOT NULL) AS rtt,
  arg_min({'t': target, 'v': delta}, {'a': -abs(delta), 'b': target}) FILTER (metric = 'delay_variation' AND delta IS NOT NULL) AS dv,
  arg_min({'t': target, 'v': delta}, {'a': -abs(delta), 'b': target}) FILTER (metric = 'packet_loss' AND delta IS NOT NULL) AS ls,
  arg_min({'t': target, 'v': peak}, {'a': -peak, 'b': target}) FILTER (metric = 'packet_loss') AS pk FROM ext_t GROUP BY run_id, event_id""")
cte("cnt_t", """
SELECT run_id, event_id, round_even(sum(observed) FILTER (metric = 'drops'), 3) AS delta_drops,
  round_even(sum(observed) FILTER (metric = 'errors'), 3) AS delta_errors FROM tr_t WHERE metric IN ('drops', 'errors') GROUP BY ALL""")
cte("fp_t", """
SELECT f.run_id, concat('FP-', f.event_id) AS fingerprint_id, 'event-fingerprint-v1' AS vector_version, f.event_id, start, "end",
  round_even(duration_seconds, 3) AS duration_seconds, severity, confidence, metrics_changed, targets, delta_utilization_pp,
  rtt.v AS delta_rtt_pct, rtt.t AS delta_rtt_target, dv.v AS delta_delay_variation_pct, dv.t AS delta_delay_variation_target,
  ls.v AS delta_loss_pp, ls.t AS delta_loss_target, pk.v AS observed_loss_peak_pct, pk.t AS observed_loss_target, delta_drops, delta_errors
FROM find_t f LEFT JOIN vec_t v ON f.run_id = v.run_id AND f.event_id = v.event_id LEFT JOIN cnt_t c ON f.run_id = c.run_id AND f.event_id = c.event_id""")
AVAILABLE = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in (
    "delta_utilization_pp", "delta_rtt_pct", "delta_delay_variation_pct", "delta_loss_pp", "delta_drops"))
statement("fingerprint_trace", f'SELECT run_id, fingerprint_id, event_id, metric, target, "timestamp", {r6("baseline observed delta")}, unit FROM tr_t')
statement("fingerprint_extremes", "SELECT * FROM ext_t")
statement("fingerprints", f"""SELECT *, {AVAILABLE} AS core_metrics_available, 5 AS core_metrics_total,
  round_even(({AVAILABLE}) / 5.0 * 100.0, 3) AS core_completeness_pct, array_to_string(list_filter([
    CASE WHEN contains(metrics_changed, 'packet_loss') AND observed_loss_peak_pct IS NOT NULL AND delta_loss_pp IS NULL
      THEN 'Δloss N/D: pérdida observada sin baseline' END,
    CASE WHEN contains(metrics_changed, 'utilization') AND delta_utilization_pp IS NULL THEN 'Δutilization N/D: sin valor utilizable' END,
    CASE WHEN list_contains(string_split(metrics_changed, '|'), 'rtt') AND delta_rtt_target IS NULL THEN 'ΔRTT N/D: sin baseline distinto de cero' END,
    CASE WHEN contains(metrics_changed, 'delay_variation') AND delta_delay_variation_target IS NULL
      THEN 'Δdelay_variation N/D: sin baseline distinto de cero' END], lambda t: t IS NOT NULL), '|') AS limitations,
  FALSE AS causal_interpretation_allowed FROM fp_t""")
