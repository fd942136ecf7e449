"""Small telemetry inputs with known results."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd

START = datetime(2026, 8, 9, 18, 0, 0)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


IFACE = ("run_id string, interface string, timestamp timestamp_ntz, row_no long, rx_bytes_delta long, tx_bytes_delta long, "
         "rx_errors_delta long, tx_errors_delta long, rx_drops_delta long, tx_drops_delta long, counter_event string, "
         "sample_status string")
PROBE = ("run_id string, target string, address string, timestamp timestamp_ntz, row_no long, packets_sent long, "
         "packets_received long, packet_loss_pct double, reachability boolean, rtt_ms double, delay_variation_ms double, "
         "sample_status string")
HOST = "run_id string, timestamp timestamp_ntz, row_no long, cpu_percent double, memory_percent double, sample_status string"


def debug_run(spark, run_id: str = "R1", samples: int = 24, anomalies=(16, 17, 18), interface: str = "eth0",
              capacity: float | None = 100.0):
    """The sealed synthetic run: 24 samples every 5 s from three sources, three of them anomalous."""
    iface, probe, host = [], [], []
    for i in range(samples):
        bad, first = i in anomalies, i == 0
        rx, tx = (92.0, 22.0) if bad else (18.0, 4.0)
        delta = lambda mbps: None if first else int(mbps * 1e6 * 5 / 8)
        iface.append((run_id, interface, at(5 * i), i, delta(rx), delta(tx), None if first else 0, None if first else 0,
                      None if first else (3 if bad else 0), None if first else 0, "initial" if first else "normal", "ok"))
        sent, got = 100, 96 if bad else 100
        probe.append((run_id, "external_reference", "203.0.113.10", at(5 * i), i, sent, got, (sent - got) / sent * 100.0, True,
                      52.0 if bad else 12.0, 18.0 if bad else 1.0, "ok"))
        host.append((run_id, at(5 * i), i, 48.0 if bad else 18.0, 36.0, "ok"))
    runs = [(run_id, interface, capacity, float(samples * 5), 5.0, 5.0, 5.0, 1, at(0), at(samples * 5), "UTC",
             "external_reference", True)]
    return (spark.createDataFrame(iface, IFACE), spark.createDataFrame(probe, PROBE), spark.createDataFrame(host, HOST),
            spark.createDataFrame(runs, "run_id string, expected_interface string, capacity_mbps double, duration_seconds double, "
                                  "interface_interval double, host_interval double, probe_interval double, target_count int, "
                                  "started timestamp_ntz, ended timestamp_ntz, timezone_name string, primary_target string, "
                                  "integrity_valid boolean"))


def history(spark, rows):
    """Rows of ``(link, day, minute, rx, capacity, latency, loss)`` as text-free history."""
    pdf = pd.DataFrame(rows, columns=["link_id", "timestamp", "rx_mbps", "tx_mbps", "capacity_mbps", "latency_ms",
                                      "packet_loss_pct", "availability_pct"])
    pdf["row_no"] = range(len(pdf))
    return spark.createDataFrame(
        pdf, "link_id string, timestamp timestamp_ntz, rx_mbps double, tx_mbps double, capacity_mbps double, latency_ms double, "
        "packet_loss_pct double, availability_pct double, row_no long")
