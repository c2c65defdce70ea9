"""Exact, order-aware analytics for machine signals on Spark DataFrames."""

__version__ = "0.1.0"
