"""Emberline: a Spark-first analytics engine for industrial plant telemetry."""
