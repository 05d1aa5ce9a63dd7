"""Process-telemetry analytics on Spark: pipelines, series, experiments, alerts and quality checks as DataFrame functions."""
