"""Drift analytics for retrieval-augmented systems as Spark DataFrame operators."""

__version__ = "0.1.0"
