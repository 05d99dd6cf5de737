"""Tidemark: labelled metric time series on Spark DataFrames."""
