"""Spark-native hybrid retrieval and evaluation engine."""
