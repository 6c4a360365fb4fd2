"""Fleet telemetry analytics on Spark: windows, labels, sequences, scoring, alerts."""
