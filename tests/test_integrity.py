import hashlib
import json

import pytest
from pyspark.sql import functions as F

from linklens import api
from linklens.operators import integrity as G
from linklens.sources import files as X
from linklens.sources import readers as S
from linklens.sources import sinks as W

FILES = "run_id string, path string, content string"
LINES = "run_id string, line_no long, line string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_manifest_states(spark):
    files = spark.createDataFrame([("R", "a.csv", "A"), ("R", "b.csv", "B"), ("R", "new.csv", "N"), ("R", "checksums.sha256", "x")], FILES)
    lines = [f"{sha('A')}  a.csv", f"{sha('old')}  b.csv", f"{sha('C')}  c.csv", "short  d.csv", f"{sha('A')}  ../x", f"{sha('A')}  /etc/x",
             f"{sha('A')}  a.csv", "", "no separator", f"{sha('A').upper()}  sub/../a.csv"]
    entries = G.parse_manifest(spark.createDataFrame([("R", i, t) for i, t in enumerate(lines, 1)], LINES))
    got = sorted((r.path or "", r.status) for r in G.verify_manifest(entries, G.file_hashes(files)).collect())
    assert got == sorted([("", "malformed"), ("../x", "unsafe"), ("/etc/x", "unsafe"), ("a.csv", "malformed"), ("a.csv", "ok"),
                          ("b.csv", "mismatched"), ("c.csv", "missing"), ("d.csv", "malformed"), ("new.csv", "untracked"),
                          ("sub/../a.csv", "ok")])
    row = G.integrity_summary(G.verify_manifest(entries, G.file_hashes(files)), True).collect()[0]
    assert (row.integrity_valid, row.checked_files, row.untracked_files) == (False, 3, 1)


def test_manifest_round_trip_on_disk(spark, tmp_path):
    root = str(tmp_path / "runs")
    for run, text in (("R1", "alpha"), ("R2", "beta")):
        folder = tmp_path / "runs" / f"run_id={run}" / "sub"
        folder.mkdir(parents=True)
        (folder / "data.csv").write_text(text)
    hashes = G.file_hashes(X.read_run_hashes(spark, root))
    assert {(r.run_id, r.path, r.sha256) for r in hashes.collect()} == {
        ("R1", "sub/data.csv", sha("alpha")), ("R2", "sub/data.csv", sha("beta"))}
    paths = W.write_checksums(str(tmp_path / "out"), hashes.select("run_id").distinct(), G.manifest_lines(hashes))
    entries = G.parse_manifest(S.read_manifests(spark, paths["checksums"]))
    assert {r.integrity_valid for r in G.integrity_summary(G.verify_manifest(entries, hashes), True).collect()} == {True}


def test_run_ids_keep_their_characters_on_both_sides(spark, tmp_path):
    names = ["r 2", "a%41", "b+c", "año"]
    hashes = spark.createDataFrame([(n, "x.csv", sha(n)) for n in names], "run_id string, path string, sha256 string")
    paths = W.write_checksums(str(tmp_path / "out"), hashes.select("run_id").distinct(), G.manifest_lines(hashes))
    assert {r.run_id for r in S.read_manifests(spark, paths["checksums"]).collect()} == set(names)
    for name in ("r 2", "b+c", "año"):
        folder = tmp_path / "runs" / f"run_id={name}"
        folder.mkdir(parents=True)
        (folder / "x.csv").write_text("x")
    assert {r.run_id for r in X.read_run_hashes(spark, str(tmp_path / "runs")).collect()} == {"r 2", "b+c", "año"}


def planted(tmp_path, run="R1", **files):
    folder = tmp_path / "runs" / f"run_id={run}"
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)
    return folder


def test_hidden_and_empty_files_are_untracked_for_their_own_run(spark, tmp_path):
    odd = {".hid": "x", "_planted": "y", "_sub/.deep/a.csv": "z", "empty.csv": "", ".alone.crc": "c"}
    planted(tmp_path, "R1", **{"a.csv": "a", ".a.csv.crc": "left by a writer", "_SUCCESS": "", **odd})
    planted(tmp_path, "R2", **{"a.csv": "a"})
    hashes = G.file_hashes(X.read_run_hashes(spark, str(tmp_path / "runs"), shares=3))
    assert {(r.run_id, r.path, r.sha256) for r in hashes.collect()} == {
        ("R2", "a.csv", sha("a")), ("R1", "a.csv", sha("a")), *(("R1", path, sha(text)) for path, text in odd.items())}
    entries = G.parse_manifest(spark.createDataFrame([(run, 1, f"{sha('a')}  a.csv") for run in ("R1", "R2")], LINES))
    verified = G.verify_manifest(entries, hashes)
    assert {(r.run_id, r.path) for r in verified.where("status = 'untracked'").collect()} == {("R1", path) for path in odd}
    assert {r.run_id: r.integrity_valid for r in G.integrity_summary(verified, True).collect()} == {"R1": False, "R2": True}


def test_links_and_line_breaks_are_refused(spark, tmp_path):
    folder = planted(tmp_path, "R1", **{"a.csv": "a"})
    (folder / "link.csv").symlink_to(folder / "a.csv")
    with pytest.raises(Exception, match="symbolic links"):
        X.read_run_hashes(spark, str(tmp_path / "runs")).collect()
    other = tmp_path / "other"
    planted(other, "R1", **{"a\nb.csv": "a"})
    with pytest.raises(Exception, match="line breaks"):
        X.read_run_hashes(spark, str(other / "runs")).collect()


def test_files_beyond_two_gigabytes_are_hashed_in_pieces(spark, tmp_path):
    folder = planted(tmp_path, "R1", **{"a.csv": "a"})
    size = (2 << 30) + 5
    with open(folder / "big.bin", "wb") as file:
        file.truncate(size)
    want = hashlib.sha256()
    for _ in range(2048):
        want.update(bytes(1 << 20))
    want.update(bytes(5))
    got = {r.path: (r.size, r.sha256) for r in X.read_run_hashes(spark, str(tmp_path / "runs")).collect()}
    assert got == {"a.csv": (1, sha("a")), "big.bin": (size, want.hexdigest())}


def test_the_driver_plans_shares_and_lists_nothing(spark, tmp_path):
    reader = X.RunFilesReader(str(tmp_path / "not there"), 5)
    assert [p.value for p in reader.partitions()] == [(i, 5) for i in range(5)]
    empty = tmp_path / "none"
    empty.mkdir()
    assert X.read_run_hashes(spark, str(empty)).count() == 0
    for i in range(20):
        planted(tmp_path, f"R{i}", **{f"f{k}.csv": str(k) for k in range(3)})
    listed = X.list_run_files(spark, str(tmp_path / "runs"), shares=4).withColumn("share", F.spark_partition_id())
    assert listed.select("run_id").distinct().count() == 20 and listed.count() == 60
    assert listed.select("share").distinct().count() > 1 and listed.groupBy("run_id").agg(F.countDistinct("share").alias("n")).where("n > 1").isEmpty()


def test_a_run_without_a_manifest_is_invalid(spark):
    files = spark.createDataFrame([("R1", "a.csv", "A"), ("R2", "a.csv", "A")], FILES)
    entries = G.parse_manifest(spark.createDataFrame([("R1", 1, f"{sha('A')}  a.csv")], LINES))
    for strict in (False, True):
        got = {r.run_id: r.integrity_valid for r in G.integrity_summary(G.verify_manifest(entries, G.file_hashes(files)), strict).collect()}
        assert got == {"R1": True, "R2": False}


def test_null_and_repeated_keys_are_no_differences(spark):
    rows = [(None, "a"), (1, "x"), (1, "y"), (1, "y"), (2, None)]
    left = spark.createDataFrame(rows, "k int, v string")
    right = spark.createDataFrame(rows[::-1], "k int, v string")
    assert G.table_diff(left, right, ["k"]).count() == 0
    more = right.unionByName(spark.createDataFrame([(None, "z")], "k int, v string"))
    assert [(r.k, r.kind, r.right) for r in G.table_diff(left, more, ["k"]).collect()] == [(None, "only_right", "z")]


def test_cell_types(spark):
    cells = ["", None, " TRUE ", "42", "-7", "1.5", ".5", "1e3", "1e999", "abc", "2026-01-01"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", G.cell_type(F.col("c")).alias("t"))
    assert [r.t for r in df.orderBy("i").collect()] == ["null", "null", "bool", "int", "int", "float", "float", "float", "text", "text", "text"]


def test_differences_respect_the_tolerance(spark):
    left = spark.createDataFrame([(1, "1.0", "x"), (2, "1.0", "x"), (3, "2", "true"), (4, "1", "x")], "k int, v string, t string")
    right = spark.createDataFrame([(1, "1.0000000005", "x"), (2, "1.001", "x"), (3, "2.0", "TRUE"), (5, "1", "x")], "k int, v string, t string")
    got = {(r.k, r.column, r.kind) for r in G.table_diff(left, right, ["k"]).collect()}
    assert got == {(2, "v", "changed"), (4, "v", "only_left"), (4, "t", "only_left"), (5, "v", "only_right"), (5, "t", "only_right")}
    verdict = G.check_reproducibility({"t": left}, {"t": left}, {"t": ["k"]}).collect()[0]
    assert (verdict.difference_count, verdict.reproducible) == (0, True)


def test_file_profiles_know_failures_only_with_a_status_column(spark):
    rows = [("R", "f", "2026-01-01 00:00:00", "eth0", "ok"), ("R", "f", "2026-01-01 00:01:00", "eth0", "error")]
    df = spark.createDataFrame(rows, "run_id string, file string, timestamp string, interface string, sample_status string").withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz"))
    known, unknown = G.file_profile(df).collect()[0], G.file_profile(df.drop("sample_status")).collect()[0]
    assert (known.failed_rows, known.duration_seconds, known.interfaces) == (1, 60.0, ["eth0"])
    assert unknown.failed_rows is None and unknown.status_source is None


def test_event_documents_come_back_whole(spark, tmp_path):
    events = spark.createDataFrame([("R", "EVENT-001", 0)], "run_id string, event_id string, z int").select(
        "run_id", "event_id", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("start"),
        F.lit("2026-01-01 04:00:00").cast("timestamp_ntz").alias("end"), F.lit(14400.0).alias("duration_seconds"),
        F.array(F.lit("rtt")).alias("metrics_changed"), F.lit("low").alias("severity"), F.lit("MEDIA").alias("confidence"),
        F.lit(5).alias("bucket_seconds"), F.lit(2500).cast("long").alias("anomalous_buckets"))
    evidence = spark.range(2500).select(
        F.lit("R").alias("run_id"), F.lit("EVENT-001").alias("event_id"),
        F.timestamp_add("SECOND", F.col("id") * 5, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")).alias("timestamp"),
        F.lit("rtt").alias("metric"), F.lit("t").alias("target"), F.col("id").cast("double").alias("observed"),
        F.lit(1.0).alias("baseline"), F.lit(2.0).alias("threshold"), F.lit(None).cast("boolean").alias("reachability"))
    path = W.write_table(W.event_documents(events, evidence), str(tmp_path / "events"), "json")
    headers, back = S.read_events(spark, path)
    assert spark.read.json(path).count() == 3  # parts of at most 1000 buckets
    assert headers.count() == 1 and S.invalid_events(headers).count() == 0
    assert back.exceptAll(evidence.select(back.columns)).count() == 0 and back.count() == 2500


def event_line(number, **changes):
    signals = [{"metric": "rtt", "target": "t", "observed": 30.0, "baseline": 10.0, "threshold": 20.0}]
    event = {"run_id": "R", "event_id": f"EVENT-{number:03d}", "start": "2026-01-01T00:00:00", "end": "2026-01-01T00:00:10", "duration_seconds": 10.0,
             "metrics_changed": ["rtt"], "severity": "low", "confidence": "MEDIA", "part_no": 0,
             "evidence": {"bucket_seconds": 5, "anomalous_buckets": 2, "buckets": [{"timestamp": "2026-01-01T00:00:05", "signals": signals}]}}
    return json.dumps({**event, **changes})


def test_landed_documents_are_analysed_only_if_every_event_is_valid(spark, tmp_path):
    relation = {"run_id": "R", "relation_id": "C1", "x_metric": "utilization_pct", "y_metric": "rtt_ms", "target": "t"}
    (tmp_path / "related.json").write_text(json.dumps(relation) + "\n")
    (tmp_path / "good.json").write_text("\n".join(map(event_line, (1, 2))) + "\n")
    vectors = api.fingerprints_from_documents(spark, str(tmp_path / "good.json")).orderBy("event_id").collect()
    assert [(r.event_id, r.targets, r.delta_rtt_pct, len(r.fingerprint_sha256)) for r in vectors] == [
        (f"EVENT-00{i}", ["t"], 200.0, 64) for i in (1, 2)]
    found = api.findings_from_documents(spark, str(tmp_path / "good.json"), str(tmp_path / "related.json")).collect()
    assert sorted((r.finding_id, r.anomalous_buckets) for r in found) == [("FINDING-001", 2), ("FINDING-002", 2)]
    bad = {"missing severity": event_line(3, severity=None), "negative duration": event_line(3, duration_seconds=-1.0), "duplicate": event_line(1)}
    for reason, line in bad.items():
        path = tmp_path / f"{reason}.json"
        path.write_text("\n".join([event_line(1), event_line(2), line]) + "\n")
        with pytest.raises(Exception, match=reason):
            api.fingerprints_from_documents(spark, str(path))
        with pytest.raises(Exception, match=reason):
            api.findings_from_documents(spark, str(path), str(tmp_path / "related.json"))


def test_report_digest_sees_every_change(spark):
    """The root is recomputed here; swapped, compensating and moved payloads all change it."""
    from linklens.operators.report import report_digest

    def table(rows):
        return spark.createDataFrame([("R", s, i, sha(p)) for s, i, p in rows], "run_id string, section string, item_no string, payload_sha256 string")

    def root(rows):
        leaves = {}
        for s, i, p in rows:
            leaves.setdefault(sha(f"{s}\x1f{i}")[:2], []).append(f"{s}\x1f{i}\x1f{sha(p)}")
        return sha("\n".join(sorted(f"{k}:{sha(chr(10).join(sorted(v)))}" for k, v in leaves.items())))

    rows = [("event", str(i), f"payload {i}") for i in range(600)] + [("run", "", "head")]
    want = root(rows)
    assert [r.report_sha256 for r in report_digest(table(rows)).collect()] == [want]
    assert report_digest(table(rows[::-1])).first().report_sha256 == want
    swapped = [("event", "0", "payload 1"), ("event", "1", "payload 0"), *rows[2:]]
    for other in (swapped, rows[1:], rows + [rows[0]], [("finding", "0", "payload 0"), *rows[1:]]):
        assert report_digest(table(other)).first().report_sha256 not in (want, None)
    assert report_digest(table([])).count() == 0
