"""Spark-native retrieval, graph-analytics and training-data engine."""
