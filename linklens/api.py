"""Entry points: landed paths in, result tables out. Nothing is collected on the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.config import EvidenceConfig, FingerprintConfig, HistoryConfig
from linklens.operators import history, ingest, integrity, quality
from linklens.operators.correlation import analyze_correlations  # noqa: F401
from linklens.operators.events import analyze_events, event_targets  # noqa: F401
from linklens.operators.evidence import analyze_evidence  # noqa: F401
from linklens.operators.fingerprint import analyze_fingerprints  # noqa: F401
from linklens.operators.integrity import check_reproducibility  # noqa: F401
from linklens.operators.profile import assess_dataset_quality  # noqa: F401
from linklens.operators.report import analysis_manifest
from linklens.plans.audit import RunAudit
from linklens.session import stage
from linklens.sources import files as run_files
from linklens.sources import readers, sinks


def analyze_history(raw: DataFrame, cfg: HistoryConfig = HistoryConfig(),
                    mapping: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Raw link history to summary, alerts, daily, hourly, processed and rejected tables."""
    cfg.validate()
    checked = stage(ingest.validate_rows(ingest.map_columns(raw, mapping)), "checked")
    links = ingest.derive_utilization(ingest.accepted_rows(checked))
    core = stage(history.link_core(links, cfg), "core")
    return {"summary": history.ranked_links(history.summarize(core)), "alerts": history.ranked_alerts(history.link_alerts(core, cfg)),
            "daily": history.daily_link(links), "hourly": history.hourly_link(links), "processed": links,
            "rejected": ingest.rejected_rows(checked), "counts": ingest.ingest_warnings(checked)}


def analyze_link_audit(raw: DataFrame, mapping: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """Short-window audit without projections."""
    links = stage(ingest.ingest(raw, mapping), "links")
    return {"summary": history.link_audit(links), "processed": links, "manifest": history.link_audit_meta(links)}


def analyze_quality(interface: DataFrame, probes: DataFrame, runs: DataFrame | None = None,
                    counter_maxima: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """Processed series, both summaries and the windows of each run."""
    iface = stage(quality.processed_interface(interface, runs, counter_maxima), "interface")
    probe = stage(quality.processed_probes(probes), "probes")
    return {"interface_summary": quality.interface_summary(iface), "probe_summary": quality.probe_summary(probe),
            "interface": iface, "probes": probe, "overlap": quality.source_overlap(iface, probe)}


def finalize_integrity(spark: SparkSession, root: str, out_dir: str, profiles: DataFrame,
                       configured: DataFrame | None = None) -> dict[str, str]:
    """Hash every file below ``root/run_id=<id>/`` and write manifests and run metadata."""
    hashes = integrity.file_hashes(run_files.read_run_hashes(spark, root))
    return sinks.write_checksums(out_dir, integrity.run_metadata(profiles, configured), integrity.manifest_lines(hashes))


def verify_integrity(spark: SparkSession, root: str, manifests: str, strict_untracked: bool = False) -> dict[str, DataFrame]:
    """Check the present files against their manifests: one row per file, one verdict per run."""
    hashes = stage(integrity.file_hashes(run_files.read_run_hashes(spark, root)), "hashes")
    entries = stage(integrity.parse_manifest(readers.read_manifests(spark, manifests)), "entries")
    files = stage(integrity.verify_manifest(entries, hashes), "verified")
    return {"files": files, "summary": integrity.integrity_summary(files, strict_untracked)}


def with_integrity(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """The verdict of :func:`verify_integrity` as the run column the gate reads; no verdict is a failure."""
    verdict = summary.select("run_id", "integrity_valid")
    return runs.drop("integrity_valid").join(verdict, "run_id", "left").withColumn(
        "integrity_valid", F.coalesce("integrity_valid", F.lit(False)))


def load_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, their evidence and their targets from event documents; one invalid event fails the load before anything is analysed."""
    events, evidence = readers.read_events(spark, path)
    return stage(readers.require_valid_events(events), "valid-events"), evidence, event_targets(evidence)


def fingerprints_from_documents(spark: SparkSession, events_path: str, cfg: FingerprintConfig = FingerprintConfig()) -> DataFrame:
    """Fingerprints of landed event documents."""
    events, evidence, targets = load_events(spark, events_path)
    return analyze_fingerprints(events, targets, evidence, cfg=cfg)


def findings_from_documents(spark: SparkSession, events_path: str, correlations_path: str, cfg: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """Findings of landed event and correlation documents."""
    events, _, targets = load_events(spark, events_path)
    return analyze_evidence(events, targets, readers.read_correlations(spark, correlations_path), cfg)


def generate_report(interface: DataFrame, probes: DataFrame, host: DataFrame, runs: DataFrame, out_dir: str,
                    **configs) -> dict[str, str]:
    """Run the whole audit and write every table and document it produces."""
    audit = RunAudit(interface, probes, host, runs, **configs)
    report, st, gate = stage(audit.report, "report"), audit.stages, audit.gate_stages
    paths = sinks.write_report_tables(f"{out_dir}/report", report, analysis_manifest(report))
    written = {
        "quality": sinks.write_quality(f"{out_dir}/quality", quality.interface_summary(st.interface),
                                       quality.probe_summary(st.probes), st.interface, st.probes,
                                       quality.source_overlap(st.interface, st.probes)),
        "gate": sinks.write_dataset_quality(f"{out_dir}/gate", gate.gate, gate.profile, gate.checks),
        "events": sinks.write_events(f"{out_dir}/events", st.events, st.evidence, st.timeline),
        "correlations": sinks.write_correlations(f"{out_dir}/correlations", audit.related.correlations, audit.related.aligned),
        "evidence": sinks.write_evidence(f"{out_dir}/evidence", audit.findings, audit.evidence_trace),
        "fingerprints": sinks.write_fingerprints(f"{out_dir}/fingerprints", audit.fingerprints, audit.fingerprint_trace)}
    for group, tables in written.items():
        paths.update({f"{group}.{name}": path for name, path in tables.items()})
    return paths
