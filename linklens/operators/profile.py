"""Data-quality profile, checks and gate of capture runs.

The three sources are profiled together in one long table
``run_id, source, grp, timestamp, row_no, ok`` (``grp`` is the interface or the
target, empty for the host), so each step is one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linklens.config import DatasetQualityConfig
from linklens.functions.scalars import not_available, number_of, seconds_between, shown, to_bool, to_timestamp
from linklens.operators.ordered import previous_valid, row_chunk, time_chunk
from linklens.session import once, stage

SOURCES = ("interface", "host", "probes")
GROUP = ["run_id", "source", "grp"]
KEYS = ["run_id", "source"]
COUNTERS = ("bytes", "packets", "errors", "drops")


def _parsed(df: DataFrame) -> DataFrame:
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        return df.withColumn("timestamp", to_timestamp(F.col("timestamp")))
    return df


def samples_long(interface: DataFrame, host: DataFrame, probes: DataFrame) -> DataFrame:
    """All sample rows of all sources, bad timestamps as null."""
    def take(df: DataFrame, source: str, grp: Column) -> DataFrame:
        ok = (F.lower(F.trim("sample_status")) == "ok") if "sample_status" in df.columns else F.lit(True)
        return _parsed(df).select("run_id", F.lit(source).alias("source"), F.coalesce(grp, F.lit("")).alias("grp"),
                                  "timestamp", "row_no", F.coalesce(ok, F.lit(False)).alias("ok"))

    return (take(interface, "interface", F.col("interface")).unionByName(take(host, "host", F.lit("")))
            .unionByName(take(probes, "probes", F.col("target"))))


def cycles(duration: Column, interval: Column) -> Column:
    planned = F.ceil(duration / interval - 1e-12).cast("long")
    return F.coalesce(F.when((duration > 0) & (interval > 0), planned), F.lit(0))


def expected_samples(runs: DataFrame) -> DataFrame:
    """Planned rows and interval per run and source; host and probes default to the interface interval."""
    base = F.coalesce("interface_interval", F.lit(0.0))
    intervals = {"interface": base, "host": F.coalesce(F.when(F.col("host_interval") != 0, F.col("host_interval")), base),
                 "probes": F.coalesce(F.when(F.col("probe_interval") != 0, F.col("probe_interval")), base)}
    per_source = [F.struct(F.lit(s).alias("source"), i.alias("interval_seconds"),
                           (cycles(F.col("duration_seconds"), i)
                            * (F.greatest(F.col("target_count"), F.lit(1)) if s == "probes" else F.lit(1))).alias("expected_rows"))
                  for s, i in intervals.items()]
    return runs.select("run_id", F.explode(F.array(*per_source)).alias("p")).select("run_id", "p.*")


def experiment_estimate(runs: DataFrame, payload_bytes: int = 32, count_per_target: int = 1) -> DataFrame:
    """Planned rows of a run and the outbound probe payload in bytes."""
    plan = expected_samples(runs).groupBy("run_id").agg(
        *[F.sum(F.when(F.col("source") == s, F.col("expected_rows"))).alias(f"{s}_rows") for s in SOURCES])
    return plan.withColumns({
        "total_rows": F.col("interface_rows") + F.col("host_rows") + F.col("probes_rows"),
        "payload_bytes": F.col("probes_rows") * count_per_target * payload_bytes})


def out_of_order(samples: DataFrame) -> DataFrame:
    """Rows earlier than the row before them in file order."""
    valid = samples.where(F.col("timestamp").isNotNull())
    rows = previous_valid(valid, GROUP, ["row_no"], ["timestamp"], F.lit(True), row_chunk())
    return rows.where(F.col("timestamp") < F.col("_prev.timestamp")).select(*GROUP, "row_no", "timestamp")


def gap_rows(samples: DataFrame) -> DataFrame:
    """Seconds since the previous sample of the group in time order, per row."""
    valid = samples.where(F.col("timestamp").isNotNull())
    rows = previous_valid(valid, GROUP, ["timestamp", "row_no"], ["timestamp"], F.lit(True), time_chunk(valid))
    return rows.select(*GROUP, "row_no", "timestamp",
                       seconds_between(F.col("_prev.timestamp"), F.col("timestamp")).alias("gap_seconds"))


def gaps(samples: DataFrame, runs: DataFrame, cfg: DatasetQualityConfig = DatasetQualityConfig()) -> DataFrame:
    """Per run and source: gaps over ``interval * gap_factor`` and the longest one."""
    spans = gap_rows(samples).join(expected_samples(runs).select(*KEYS, "interval_seconds"), KEYS)
    timed = F.col("interval_seconds") > 0
    return spans.groupBy(*KEYS).agg(
        F.count_if(timed & (F.col("gap_seconds") > F.col("interval_seconds") * cfg.gap_factor)).alias("gaps"),
        F.max(F.when(timed, F.col("gap_seconds"))).alias("max_gap_seconds"))


def duplicate_samples(samples: DataFrame) -> DataFrame:
    """Repeats beyond the first per run and source; copies collapse before the shuffle."""
    copies = samples.where(F.col("timestamp").isNotNull()).groupBy(*GROUP, "timestamp").agg(F.count(F.lit(1)).alias("_n"))
    return copies.groupBy(*KEYS).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def outside_window(runs: DataFrame, cfg: DatasetQualityConfig = DatasetQualityConfig()) -> Column:
    """True for a timestamp outside the orchestrated window and its tolerance; needs the run columns."""
    slack = F.make_dt_interval(secs=F.lit(float(cfg.clock_tolerance_seconds)))
    return F.coalesce((F.col("timestamp") < F.col("started") - slack) | (F.col("timestamp") > F.col("ended") + slack),
                      F.lit(False))


def timestamp_profile(samples: DataFrame, runs: DataFrame,
                      cfg: DatasetQualityConfig = DatasetQualityConfig()) -> DataFrame:
    window = samples.join(runs.select("run_id", "started", "ended"), "run_id", "left")
    facts = window.groupBy(*KEYS).agg(
        F.count_if(F.col("timestamp").isNull()).alias("invalid_timestamps"),
        F.count_if(outside_window(runs, cfg)).alias("outside_run_window"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    disorder = out_of_order(samples).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("out_of_order"))
    return (facts.join(disorder, KEYS, "left").join(duplicate_samples(samples), KEYS, "left")
            .join(gaps(samples, runs, cfg), KEYS, "left").fillna(0, ["out_of_order", "duplicates", "gaps"]))


def coverage(actual: Column, expected: Column) -> Column:
    return (F.when((expected == 0) & (actual == 0), 100.0).when(expected <= 0, 0.0)
            .otherwise(F.least(actual, expected) / expected * 100.0))


def source_profile(samples: DataFrame, runs: DataFrame,
                   cfg: DatasetQualityConfig = DatasetQualityConfig()) -> DataFrame:
    """Per run and source: expected, actual, valid and error rows, shares, timestamp quality."""
    counts = samples.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("actual_rows"), F.count_if("ok").alias("valid_rows"))
    rows = (expected_samples(runs).join(counts, KEYS, "left").join(timestamp_profile(samples, runs, cfg), KEYS, "left")
            .fillna(0, ["actual_rows", "valid_rows", "invalid_timestamps", "outside_run_window", "out_of_order",
                        "duplicates", "gaps"]))
    actual = F.col("actual_rows")
    return rows.withColumns({
        "error_rows": actual - F.col("valid_rows"),
        "coverage_pct": F.bround(coverage(actual, F.col("expected_rows")), 6),
        "valid_pct": F.bround(F.when(actual > 0, F.col("valid_rows") / actual * 100.0).otherwise(0.0), 6)})


def _count(df: DataFrame, rules: list[Column], name: str) -> DataFrame:
    total = F.lit(0).cast("long")
    for rule in rules:
        total = total + F.count_if(rule)
    return df.groupBy("run_id").agg(total.alias(name))


def impossible_values(interface: DataFrame, host: DataFrame, probes: DataFrame) -> DataFrame:
    """Cells that cannot be true, counted per run and source."""
    def negative(df, names):
        return [number_of(df, c) < 0 for c in names if c in df.columns]

    def outside(df, names):
        return [(number_of(df, c) < 0) | (number_of(df, c) > 100) for c in names if c in df.columns]

    counters = [f"{side}_{c}{tail}" for side in ("rx", "tx") for c in COUNTERS for tail in ("", "_delta")]
    sent_rule = ([number_of(probes, "packets_received") > number_of(probes, "packets_sent")]
                 if {"packets_sent", "packets_received"} <= set(probes.columns) else [])
    parts = [
        _count(interface, negative(interface, counters), "impossible_interface"),
        _count(host, outside(host, ("cpu_percent", "memory_percent")) + negative(host, ("uptime_seconds", "uptime")),
               "impossible_host"),
        _count(probes, negative(probes, ("packets_sent", "packets_received", "payload_bytes",
                                         "estimated_outbound_payload_bytes")) + sent_rule
               + outside(probes, ("packet_loss_pct",)), "impossible_probes")]
    joined = parts[0].join(parts[1], "run_id", "full_outer").join(parts[2], "run_id", "full_outer")
    names = ["impossible_interface", "impossible_host", "impossible_probes"]
    return joined.fillna(0, names).withColumn("impossible_values_total", sum((F.col(n) for n in names[1:]), F.col(names[0])))


def counter_events(interface: DataFrame) -> DataFrame:
    event = F.lower("counter_event") if "counter_event" in interface.columns else F.lit("")
    return interface.groupBy("run_id").agg(F.count_if(F.contains(event, F.lit("reset"))).alias("counter_resets"),
                                           F.count_if(F.contains(event, F.lit("overflow"))).alias("counter_overflows"))


def interface_match(interface: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether the one observed interface is the expected one."""
    seen = interface.groupBy("run_id").agg(F.min("interface").alias("_first"), F.max("interface").alias("_last"),
                                           F.count_distinct("interface").alias("observed_interfaces"))
    expected = F.trim("expected_interface")
    same = (expected != "") & (F.col("_first") == expected) & (F.col("_last") == expected)
    return runs.select("run_id", "expected_interface").join(seen, "run_id", "left").select(
        "run_id", "expected_interface", F.coalesce("observed_interfaces", F.lit(0)).alias("observed_interfaces"),
        F.col("_first").alias("observed_interface"), F.coalesce(same, F.lit(False)).alias("interface_match"))


def unreachable_rows(probes: DataFrame) -> DataFrame:
    down = ~to_bool(F.col("reachability")) if "reachability" in probes.columns else F.lit(False)
    return probes.groupBy("run_id").agg(F.count_if(down).alias("unreachable_probe_rows"))


def run_facts(profile: DataFrame, interface: DataFrame, host: DataFrame, probes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per run with everything the run-level checks need."""
    totals = profile.groupBy("run_id").agg(*[F.sum(c).alias(f"{name}_total") for c, name in (
        ("expected_rows", "expected_rows"), ("actual_rows", "actual_rows"), ("valid_rows", "valid_rows"), ("gaps", "gaps"),
        ("duplicates", "duplicates"), ("out_of_order", "out_of_order"), ("invalid_timestamps", "invalid_timestamps"))])
    rows = runs.select("run_id", "started", "ended", "timezone_name", "integrity_valid").join(totals, "run_id", "left")
    for part in (interface_match(interface, runs), impossible_values(interface, host, probes), counter_events(interface),
                 unreachable_rows(probes)):
        rows = rows.join(part, "run_id", "left")
    return rows.fillna(0, ["impossible_interface", "impossible_host", "impossible_probes", "impossible_values_total",
                           "counter_resets", "counter_overflows", "unreachable_probe_rows"])


def _check(check_id, status: Column, blocking, detail: Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(check_id).alias("check_id"), status.alias("status"), lit(blocking).alias("blocking"),
                    detail.alias("detail"))


def _passes(ok: Column, otherwise: str) -> Column:
    return F.when(ok, "PASS").otherwise(otherwise)


def _share(value: Column, warn: float, fail: float) -> Column:
    return F.when(value < fail, "FAIL").when(value < warn, "WARN").otherwise("PASS")


def quality_checks(profile: DataFrame, facts: DataFrame, cfg: DatasetQualityConfig = DatasetQualityConfig()) -> DataFrame:
    """Eighteen rows per run: ``run_id, check_id, status, blocking, detail``."""
    text = lambda c: F.col(c).cast("string")
    c, lit = F.concat, F.lit
    covered = _share(F.col("coverage_pct"), cfg.warning_coverage_pct, cfg.fail_coverage_pct)
    valid = _share(F.col("valid_pct"), cfg.warning_valid_pct, cfg.fail_valid_pct)
    invalid = F.col("invalid_timestamps") > 0
    uneven = (F.col("out_of_order") > 0) | (F.col("duplicates") > 0) | (F.col("outside_run_window") > 0)
    name = lambda tail: c(F.col("source"), lit(tail))
    per_source = profile.select("run_id", F.explode(F.array(
        _check(name(".coverage"), covered, covered == "FAIL", c(text("actual_rows"), lit("/"), text("expected_rows"), lit(" filas"))),
        _check(name(".valid_samples"), valid, valid == "FAIL", c(text("valid_rows"), lit("/"), text("actual_rows"), lit(" válidas"))),
        _check(name(".timestamps"), F.when(invalid, "FAIL").when(uneven, "WARN").otherwise("PASS"), invalid, c(
            lit("inválidos="), text("invalid_timestamps"), lit(", fuera_de_orden="), text("out_of_order"),
            lit(", duplicados="), text("duplicates"), lit(", fuera_de_ventana="), text("outside_run_window"))),
        _check(name(".gaps"), _passes(F.col("gaps") == 0, "WARN"), False, c(
            lit("huecos="), text("gaps"), lit("; máximo="), F.coalesce(shown(F.col("max_gap_seconds"), 3), lit("N/D")))),
    )).alias("k")).select("run_id", "k.*")
    impossible = F.col("impossible_values_total") > 0
    zoned = F.coalesce(F.col("timezone_name") != "", lit(False)) & F.col("started").isNotNull() & F.col("ended").isNotNull()
    per_run = facts.select("run_id", F.explode(F.array(
        _check("integrity.strict", _passes(F.coalesce("integrity_valid", lit(False)), "FAIL"), True, lit("SHA-256")),
        _check("interface.expected", _passes(F.col("interface_match"), "FAIL"), True, c(
            lit("esperada="), not_available(F.col("expected_interface")), lit("; observada="), not_available(F.col("observed_interface")))),
        _check("values.possible", _passes(~impossible, "FAIL"), impossible, c(lit("imposibles="), text("impossible_values_total"))),
        _check("interface.counter_resets", _passes(F.col("counter_resets") == 0, "WARN"), False, c(
            lit("resets="), text("counter_resets"), lit("; overflows="), text("counter_overflows"))),
        _check("probes.reachability", _passes(F.col("unreachable_probe_rows") == 0, "WARN"), False, c(
            lit("no_alcanzables="), text("unreachable_probe_rows"))),
        _check("clock.context", _passes(zoned, "WARN"), False, c(lit("timezone="), not_available(F.col("timezone_name")))),
    )).alias("k")).select("run_id", "k.*")
    return per_run.unionByName(per_source)


def quality_gate(checks: DataFrame, facts: DataFrame) -> DataFrame:
    """Run status, whether conclusions are allowed, and the totals."""
    failed = F.col("status") == "FAIL"
    verdict = checks.groupBy("run_id").agg(F.bool_or(failed & F.col("blocking")).alias("_blocked"),
                                           F.bool_or(failed).alias("_fail"), F.bool_or(F.col("status") == "WARN").alias("_warn"))
    status = F.when(F.col("_fail"), "FAIL").when(F.col("_warn"), "WARN").otherwise("PASS")
    return facts.join(verdict, "run_id").select(
        "run_id", status.alias("status"), (~F.col("_blocked") & (status != "FAIL")).alias("safe_for_conclusions"),
        "expected_rows_total", "actual_rows_total", "valid_rows_total",
        F.bround(coverage(F.col("valid_rows_total"), F.col("expected_rows_total")), 6).alias("temporal_integrity_pct"),
        "gaps_total", "duplicates_total", "out_of_order_total", "invalid_timestamps_total", "counter_resets",
        "counter_overflows", "impossible_values_total", "unreachable_probe_rows", "expected_interface", "observed_interfaces")


def collector_health(samples: DataFrame) -> DataFrame:
    """Row facts per run and source, and whether any source met errors."""
    return samples.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("ok")).alias("error_rows"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp")).withColumn(
        "collector_status", F.when(F.col("error_rows") > 0, "completed_with_sample_errors").otherwise("completed"))


class QualityStages:
    """Stages of the gate over many runs; shared tables are written once."""

    def __init__(self, interface: DataFrame, host: DataFrame, probes: DataFrame, runs: DataFrame,
                 cfg: DatasetQualityConfig = DatasetQualityConfig()):
        self.interface, self.host, self.probes, self.runs, self.cfg = interface, host, probes, runs, cfg.validate()

    @once
    def samples(self) -> DataFrame:
        return stage(samples_long(self.interface, self.host, self.probes), "samples")

    @once
    def profile(self) -> DataFrame:
        return stage(source_profile(self.samples, self.runs, self.cfg), "profile")

    @once
    def facts(self) -> DataFrame:
        return stage(run_facts(self.profile, self.interface, self.host, self.probes, self.runs), "facts")

    @once
    def checks(self) -> DataFrame:
        return quality_checks(self.profile, self.facts, self.cfg)

    @once
    def gate(self) -> DataFrame:
        return stage(quality_gate(self.checks, self.facts), "gate")


def assess_dataset_quality(interface: DataFrame, host: DataFrame, probes: DataFrame, runs: DataFrame,
                           cfg: DatasetQualityConfig = DatasetQualityConfig()) -> DataFrame:
    return QualityStages(interface, host, probes, runs, cfg).gate
