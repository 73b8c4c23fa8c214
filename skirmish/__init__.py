"""Spark-native analytics for match-based player telemetry."""
