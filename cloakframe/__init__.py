"""Spark-native reversible de-identification of text and tables."""
