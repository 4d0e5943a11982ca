"""Spark-native provider-integrity analytics and training-data operators."""
