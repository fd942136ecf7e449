"""DuckDB statements that state each query a second time, independently of the Spark plans."""

from linklens.plans.oracle import history, telemetry, quality, report  # noqa: F401
from linklens.plans.oracle.base import STATEMENTS


def statements() -> dict[str, str]:
    return dict(STATEMENTS)
