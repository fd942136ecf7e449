"""Landed paths to written results, end to end."""

import pytest
from pyspark.sql import functions as F

from linklens import api
from linklens.config import ConfigError, HistoryConfig, ReportConfig
from linklens.sources import readers
from tests.helpers import debug_run


def test_history_end_to_end(spark, tmp_path):
    path = tmp_path / "demo.csv"
    lines = ["fecha,enlace,rx,tx,capacidad"]
    lines += [f"2026-01-{d:02d} {h:02d}:00:00,A,{40 + d},5,100" for d in range(1, 15) for h in range(0, 24, 6)]
    path.write_text("\n".join(lines + ["bad,A,1,1,100"]), encoding="utf-8")
    tables = api.analyze_history(readers.read_history(spark, str(path)))
    assert tables["summary"].collect()[0].trend_direction == "CRECIENTE"
    assert tables["rejected"].count() == 1 and tables["counts"].collect()[0].accepted_rows == 56
    assert api.analyze_link_audit(readers.read_history(spark, str(path)))["manifest"].collect()[0].links == 1


def test_sealed_run_to_report(spark, tmp_path):
    iface, probe, host, runs = debug_run(spark)
    other = debug_run(spark, run_id="R2", interface="wlan9", anomalies=())
    both = [a.unionByName(b) for a, b in zip((iface, probe, host, runs), other)]
    runs = both[3].withColumn("expected_interface", F.lit("eth0"))
    paths = api.generate_report(both[0], both[1], both[2], runs, str(tmp_path / "out"), report=ReportConfig(company="X"))
    report = spark.read.json(paths["report"])
    sections = {(r.run_id, r.section) for r in report.select("run_id", "section").distinct().collect()}
    assert ("R1", "finding") in sections and ("R2", "finding") not in sections and ("R2", "check") in sections
    manifest = {r.run_id: r for r in spark.read.json(paths["manifest"]).collect()}
    assert manifest["R1"].analysis_executed and manifest["R1"].event_count == 1
    assert not manifest["R2"].analysis_executed and manifest["R2"].check_count == 18
    headers, evidence = readers.read_events(spark, paths["events.events"])
    assert headers.count() == 1 and evidence.select("metric").distinct().count() == 5


def test_integrity_verdict_reaches_the_gate(spark, tmp_path):
    folder = tmp_path / "runs" / "run_id=R1"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("x")
    root, (iface, probe, host, runs) = str(tmp_path / "runs"), debug_run(spark)
    profiles = api.integrity.file_profile(iface.withColumn("file", F.lit("f")))
    manifests = api.finalize_integrity(spark, root, str(tmp_path / "seal"), profiles)["checksums"]
    good = api.with_integrity(runs, api.verify_integrity(spark, root, manifests, True)["summary"])
    assert api.assess_dataset_quality(iface, host, probe, good).collect()[0].status == "PASS"
    (folder / "a.csv").write_text("tampered")
    bad = api.with_integrity(runs, api.verify_integrity(spark, root, manifests, True)["summary"])
    assert api.assess_dataset_quality(iface, host, probe, bad).collect()[0].safe_for_conclusions is False


def test_parameters_are_checked():
    assert HistoryConfig(**{"critical_threshold": 0.9}).validate().critical_threshold == 0.9
    with pytest.raises(ConfigError):
        HistoryConfig(warning_threshold=0.99).validate()
    with pytest.raises(TypeError):
        HistoryConfig(**{"nope": 1})


def test_run_configuration_documents(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text('{"run": {"run_id": " R1 ", "duration_seconds": 14400}, "interface": {"name": "eth0", "interval_seconds": 5, '
                    '"capacity_mbps": null}, "host": {"interval_seconds": 5}, "probes": {"interval_seconds": 5, "payload_bytes": 32, '
                    '"count_per_target": 1}, "targets": [{"name": "a"}, {"name": "b"}, {"name": "c"}]}')
    from linklens.operators.profile import experiment_estimate
    runs = readers.read_run_configs(spark, str(path), multi_line=True)
    row = experiment_estimate(runs).collect()[0]
    assert (row.run_id, row.interface_rows, row.host_rows, row.probes_rows, row.total_rows) == ("R1", 2880, 2880, 8640, 14400)
    assert row.payload_bytes == 276480 and runs.collect()[0].capacity_mbps is None


def test_a_bad_timestamp_fails_the_strict_load(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("bad",)], "timestamp string")
    with pytest.raises(Exception, match="invalid timestamp"):
        readers.read_samples(df, ["timestamp"]).collect()


def test_the_strict_load_fails_whatever_is_read(spark, tmp_path):
    spark.createDataFrame([("2026-01-01T00:00:00Z", 1.0), ("bad", 2.0)], "timestamp string, v double").write.parquet(str(tmp_path / "t"))
    rows = readers.read_samples(spark.read.parquet(str(tmp_path / "t")), ["timestamp"])
    for read in (lambda: rows.count(), lambda: rows.agg(F.sum("v")).collect(), lambda: rows.select("v").collect()):
        with pytest.raises(Exception, match="invalid timestamp"):
            read()


def test_history_format_is_not_guessed_when_it_is_given(spark, tmp_path):
    columns = "fecha string, enlace string, rx string, tx string, capacidad string"
    spark.createDataFrame([("2026-01-01 00:00:00", "A", "1", "2", "10")], columns).write.parquet(str(tmp_path / "table"))
    assert readers.read_history(spark, str(tmp_path / "table"), file_format="parquet").first().link_id == "A"
