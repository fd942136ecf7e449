from datetime import datetime, timedelta

import pytest

from linklens.config import ConfigError, HistoryConfig
from linklens.operators import history as H
from linklens.operators import ingest as I
from linklens.operators.ingest import SchemaError, map_columns, normalize_name, resolve_columns
from linklens.sources.readers import read_history
from tests.helpers import history

DAY = datetime(2026, 1, 1)


def days(link, n, rx, per_day=4, capacity=100.0, tx=5.0):
    return [(link, DAY + timedelta(days=d, hours=6 * h), float(rx(d, h)), tx, capacity, None, None, None)
            for d in range(n) for h in range(per_day)]


def summary(spark, rows, cfg=HistoryConfig()):
    return {r.link_id: r for r in H.link_summary(I.derive_utilization(history(spark, rows)), cfg).collect()}


def test_headers_resolve_by_alias_and_manual_mapping():
    assert normalize_name("  Pérdida de Paquetes (%) ") == "perdida_de_paquetes"
    columns = ["Fecha", "Enlace", "Entrada Mbps", "Salida Mbps", "Capacidad", "extra"]
    assert list(resolve_columns(columns).values()) == ["timestamp", "link_id", "rx_mbps", "tx_mbps", "capacity_mbps", "extra"]
    assert resolve_columns(["valor"], {"Valor": "rx_mbps"}) == {"valor": "rx_mbps"}
    with pytest.raises(SchemaError):
        resolve_columns(["rx", "download_mbps"])
    with pytest.raises(SchemaError):
        resolve_columns(["a"], {"a": "nonsense"})


def test_reading_a_semicolon_file_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text("﻿Fecha;Enlace;Entrada Mbps;Salida Mbps;Capacidad\n2026-01-01 00:00:00;A;10;5;100\n", encoding="utf-8")
    row = I.ingest(read_history(spark, str(path))).collect()[0]
    assert (row.link_id, row.rx_mbps, row.utilization, row.bottleneck_direction) == ("A", 10.0, 0.1, "RX")


def test_missing_required_columns_are_named(spark):
    with pytest.raises(SchemaError, match="capacity_mbps, link_id"):
        I.typed(spark.createDataFrame([("2026-01-01", "1", "1")], "timestamp string, rx_mbps string, tx_mbps string"))


def test_first_failing_rule_names_the_reason_and_rejected_rows_count_for_duplicates(spark):
    rows = [("2026-01-01 00:00:00", "A", "10", "5", "100"), ("2026-01-01 00:00:00", "A", "11", "5", "100"),
            ("bad", "A", "x", "5", "100"), ("2026-01-01 00:05:00", " ", "1", "1", "100"),
            ("2026-01-01 00:06:00", "A", "1", "1", "0"), ("2026-01-01 00:06:00", "A", "1", "1", "10"),
            ("2026-01-01 00:07:00", "A", "inf", "1", "10")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)],
                               "timestamp string, link_id string, rx_mbps string, tx_mbps string, capacity_mbps string, row_no long")
    checked = I.validate_rows(df)
    got = {r.row_no: r.rejection_reason for r in checked.collect()}
    dup = "registro duplicado para enlace y timestamp"
    assert got == {0: None, 1: dup, 2: "timestamp inválido", 3: "link_id vacío", 4: "capacity_mbps debe ser > 0", 5: dup,
                   6: "rx_mbps inválido"}
    counts = I.ingest_warnings(checked).collect()[0]
    assert counts.accepted_rows + counts.rejected_rows == counts.total_rows == 7


def test_over_capacity_rows_are_kept_and_flagged(spark):
    df = I.derive_utilization(history(spark, [("A", DAY, 110.0, 5.0, 100.0, None, None, None)]))
    assert df.collect()[0].over_capacity is True


def test_capacity_ladder_and_status(spark):
    got = summary(spark, days("big", 3, lambda d, h: 143, capacity=150.0) + days("hot", 4, lambda d, h: 90))
    assert got["big"].technical_required_capacity_mbps == pytest.approx(143 / 0.70)
    assert got["big"].recommended_capacity_mbps == 250.0
    assert got["hot"].status == "CRÍTICO"


def test_growth_is_projected_and_flat_is_not(spark):
    got = summary(spark, days("up", 14, lambda d, h: 50 + d) + days("flat", 14, lambda d, h: 40 + 0.01 * (h % 2)))
    assert got["up"].trend_direction == "CRECIENTE" and got["up"].trend_reliable
    assert got["up"].trend_r2 > 0.9 and got["up"].days_to_critical is not None
    assert got["flat"].trend_direction == "ESTABLE" and got["flat"].days_to_critical is None


def test_two_days_are_not_a_trend(spark):
    row = summary(spark, days("short", 2, lambda d, h: 50))["short"]
    assert (row.trend_direction, row.trend_confidence, row.trend_reliable) == ("SIN_DATOS", "INSUFICIENTE", False)


def test_load_and_quality_rising_together_is_a_strong_association(spark):
    rows = [("Q", DAY + timedelta(minutes=5 * i), 20.0 + i, 1.0, 100.0, 10.0 + i, 0.05 * i, 100.0) for i in range(75)]
    row = summary(spark, rows)["Q"]
    assert row.quality_load_association == "FUERTE" and row.util_latency_spearman > 0.9
    kinds = {r.type for r in H.link_alerts(H.link_core(I.derive_utilization(history(spark, rows)))).collect()}
    assert "CARGA_CALIDAD" in kinds


def test_ranking_puts_the_worst_first(spark):
    df = I.derive_utilization(history(spark, days("calm", 3, lambda d, h: 10) + days("hot", 3, lambda d, h: 95)))
    assert [r.link_id for r in H.ranked_links(H.link_summary(df)).collect()] == ["hot", "calm"]


def test_link_audit_has_no_projection(spark):
    rows = [("A", DAY + timedelta(minutes=5 * i), 20.0 + i, 1.0, 100.0, 10.0, 0.0, 100.0) for i in range(49)]
    row = H.link_audit(I.derive_utilization(history(spark, rows))).collect()[0]
    assert row.duration_minutes == 240.0 and row.samples == 49
    assert not {"days_to_critical", "recommended_capacity_mbps", "trend_direction"} & set(row.asDict())


def test_config_is_checked():
    with pytest.raises(ConfigError):
        HistoryConfig(warning_threshold=0.9).validate()
    with pytest.raises(ConfigError):
        HistoryConfig(critical_days=100).validate()
