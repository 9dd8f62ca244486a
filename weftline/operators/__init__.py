"""Operators over DataFrames: data tests, unit tests and source freshness."""
