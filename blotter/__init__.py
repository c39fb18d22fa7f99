"""Spark-native analytics over large tables of incident records."""
