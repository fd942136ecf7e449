"""The DuckDB statements on the smallest tables."""

import pytest

from linklens.llm.catalog import QUERIES
from linklens.llm.oracle import STATEMENTS
from tests.llm.conftest import SF
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_query_equals_its_statement(spark, key):
    ok, detail = compare(spark, duck(SF), key, QUERIES[key], STATEMENTS[key], SF)
    assert ok, detail


def test_every_operator_has_a_query():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))
