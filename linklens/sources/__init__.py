"""Readers and writers for landed telemetry tables and documents."""
