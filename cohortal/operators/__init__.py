"""Operators on DataFrames in long form."""
