"""Tessaline: retrieval analytics, event processing and offline evaluation on Spark DataFrames."""

__version__ = "0.1.0"
