"""Loam: a PySpark-native analytics engine for text and code corpora."""
