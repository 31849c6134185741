"""Spark-native vector analytics and corpus preparation."""

__version__ = "0.1.0"
