"""Run audit, telemetry views over the driver tables, and the query catalog."""
