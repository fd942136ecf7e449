"""A cross-section of the queries against DuckDB; all of them: ``python -m tests.oracle_check``."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
KEYS = ("validate_rows", "link_summary", "link_alerts", "systematic_sample", "counter_delta", "parse_probe_logs", "probe_summary",
        "events_rollup", "correlations", "findings", "fingerprints", "source_profile", "quality_gate", "verify_manifest", "diff_limit",
        "stream_events", "stream_buckets", "run_metadata")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_its_statement(spark, con, key):
    ok, detail = compare(spark, con, key, queries()[key], oracle_sql()[key], SF)
    assert ok, detail


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    from linklens.plans.catalog import QUERIES
    assert set(QUERIES) - set(oracle_sql()) <= {"fingerprint_hash"}


def test_entry_runs(spark):
    assert entry(spark).count() == 15
