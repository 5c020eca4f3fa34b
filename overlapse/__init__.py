"""Overlapse: a Spark-first engine for finding and resolving partial duplicates."""

__version__ = "0.1.0"
