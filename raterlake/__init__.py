"""Spark-native analytics for blinded rating studies."""

__version__ = "0.1.0"
