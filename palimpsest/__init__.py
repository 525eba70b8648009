"""Palimpsest: versioned page logs as DataFrames, on PySpark."""
