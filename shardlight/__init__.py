"""Spark-native vector and document analytics engine."""

__version__ = "0.1.0"
