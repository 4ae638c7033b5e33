"""Lodeframe: a small typed SQL dialect, a dataset catalog and corpus operators on Spark DataFrames."""

__version__ = "0.1.0"
