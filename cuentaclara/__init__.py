"""Spark-native analytics for multi-tenant expense auditing."""

__version__ = "0.1.0"
