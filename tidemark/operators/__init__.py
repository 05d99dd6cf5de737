"""Operators on sample DataFrames."""
