"""Spark-native catalog, similarity and evaluation engine."""
