"""The conformance operators, each a function from DataFrames to a DataFrame."""
