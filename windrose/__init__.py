"""Spark-native analytics for movement events, hourly weather and the tables derived from them."""
