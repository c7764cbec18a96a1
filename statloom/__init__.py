"""Spark-native analytics for published statistics tables."""
