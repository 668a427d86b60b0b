"""Spark-first analytics engine for curating large training corpora."""

__version__ = "0.1.0"
