"""Spark-native analytics over benchmark result tables."""
