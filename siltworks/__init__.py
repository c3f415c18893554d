"""Tabular data conformance and corpus preparation on Spark DataFrames."""
