"""The whole run audit over landed sample tables, many runs in one job."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from linklens.config import (
    CorrelationConfig, DatasetQualityConfig, EventThresholds, EvidenceConfig, FingerprintConfig, ReportConfig,
)
from linklens.operators.correlation import CorrelationStages
from linklens.operators.counters import counter_delta
from linklens.operators.events import EventStages
from linklens.operators.evidence import event_correlations, evidence_trace, findings, top_correlations
from linklens.operators.fingerprint import fingerprint_trace, fingerprints, loss_baseline
from linklens.operators.profile import QualityStages
from linklens.operators.quality import interface_summary, probe_summary, processed_interface, processed_probes, with_rates
from linklens.operators.report import executive_summary, headline_metrics, run_report, safe_only
from linklens.session import once, stage, together


class RunAudit:
    """Quality gate, events, correlations, findings, fingerprints and report.

    Each intermediate is written once to the shared folder on first use;
    independent ones are submitted together. Only runs with a safe gate reach
    the analysis sections of the report.
    """

    def __init__(self, interface: DataFrame, probes: DataFrame, host: DataFrame, runs: DataFrame, *,
                 counter_maxima: Mapping[str, int] | None = None, thresholds: EventThresholds = EventThresholds(),
                 correlation: CorrelationConfig = CorrelationConfig(), evidence: EvidenceConfig = EvidenceConfig(),
                 fingerprint: FingerprintConfig = FingerprintConfig(),
                 quality: DatasetQualityConfig = DatasetQualityConfig(), report: ReportConfig = ReportConfig()):
        self.runs, self.host = stage(runs, "runs"), host
        self.evidence_config, self.fingerprint_config, self.report_config = evidence.validate(), fingerprint.validate(), report.validate()
        if "rx_bytes_delta" in interface.columns:
            raw, processed = interface, processed_interface(interface, self.runs, counter_maxima)
        else:  # deltas are computed once, for the gate and the series
            raw = stage(counter_delta(interface, counter_maxima), "counted")
            processed = with_rates(raw, self.runs)
        self.gate_stages = QualityStages(raw, host, probes, self.runs, quality)
        self.stages = EventStages(processed, processed_probes(probes), thresholds)
        self._correlation = correlation

    @once
    def gate(self) -> DataFrame:
        return self.gate_stages.gate

    @once
    def related(self) -> CorrelationStages:
        self.stages.load()
        return CorrelationStages(self.stages.interface, self.stages.probes, self.host, self._correlation)

    @once
    def headline(self) -> DataFrame:
        st = self.stages
        st.load()
        interfaces, targets, _ = together(lambda: stage(interface_summary(st.interface)),
                                          lambda: stage(probe_summary(st.probes)), lambda: st.events)
        return stage(headline_metrics(self.runs, interfaces, targets, st.events), "headline")

    @once
    def references(self) -> DataFrame:
        related = self.related
        _, _, found = together(lambda: self.stages.events, lambda: self.stages.targets, lambda: related.correlations)
        linked = event_correlations(self.stages.events, self.stages.targets, found, self.evidence_config)
        return stage(top_correlations(linked, self.evidence_config), "references")

    @once
    def findings(self) -> DataFrame:
        return stage(findings(self.stages.events, self.stages.targets, self.references), "findings")

    @once
    def evidence_trace(self) -> DataFrame:
        return evidence_trace(self.findings, self.references)

    @once
    def fingerprint_trace(self) -> DataFrame:
        return stage(fingerprint_trace(loss_baseline(self.stages.evidence, self.stages.probe_base)), "trace")

    @once
    def fingerprints(self) -> DataFrame:
        st = self.stages
        return stage(fingerprints(st.events, st.targets, self.fingerprint_trace, self.fingerprint_config), "fingerprints")

    @once
    def summary(self) -> DataFrame:
        together(lambda: self.gate, lambda: self.headline, lambda: self.findings)
        return executive_summary(self.runs, self.gate, self.headline, safe_only(self.findings, self.gate), self.report_config)

    @once
    def report(self) -> DataFrame:
        g, st = self.gate_stages, self.stages
        together(lambda: self.summary, lambda: self.fingerprints)
        return run_report(self.runs, g.gate, g.checks, g.profile, self.headline, self.summary, st.events, self.findings,
                          self.fingerprints, self.report_config)
