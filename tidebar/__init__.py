"""Spark-native analytics over bar-level market data and event streams."""

__version__ = "0.1.0"
