"""Operators over normalised entries and forensic records, each a function from DataFrames to a DataFrame."""
