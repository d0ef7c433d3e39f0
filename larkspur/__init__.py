"""Relational analytics on Spark DataFrames: a small SQL dialect and a matching Python API."""
