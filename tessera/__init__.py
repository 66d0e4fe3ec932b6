"""Spark-native analysis of large document corpora."""
