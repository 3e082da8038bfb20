"""Spark-native entity-resolution and library analytics."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
