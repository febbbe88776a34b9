"""Keeps a clean table of job postings with Spark DataFrames."""

__version__ = "1.0.0"
