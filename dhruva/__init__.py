"""Spark-first analytics for multilingual public-transport records and questions."""

__version__ = "0.1.0"
