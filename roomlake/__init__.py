"""Spark-native analytics for indoor 3-D scan tables."""
