"""Spark-native analytics over code-change evidence, ratings and training text."""

__version__ = "0.1.0"
