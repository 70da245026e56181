"""Vellum: Spark-native analytics for large corpora of technical drawings."""
