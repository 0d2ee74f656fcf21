"""Spark-native structuring and audit of very long texts."""
