"""Operators on ordered record streams: each takes DataFrames and column names and returns a DataFrame."""
