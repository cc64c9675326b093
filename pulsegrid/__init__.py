"""Anomaly analytics over machine telemetry, expressed as Spark DataFrame jobs."""
