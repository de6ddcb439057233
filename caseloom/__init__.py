"""Spark-native analytics for case corpora, label evaluation and training data."""
