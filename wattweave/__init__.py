"""Spark-native analytics for large collections of meter and weather series."""
