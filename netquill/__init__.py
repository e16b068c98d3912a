"""Spark-native analytics for network flow records."""
