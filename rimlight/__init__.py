"""Spark-native analytics for tyre-sidewall readings, plus table tools around them."""

__version__ = "0.1.0"
