"""Retrieval indexes over large collections of source files, built on Spark DataFrames."""

__version__ = "0.1.0"
