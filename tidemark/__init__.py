"""Spark-native analytics for evolving topics over text and vector streams."""

__version__ = "0.1.0"
