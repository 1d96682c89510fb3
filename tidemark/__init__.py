"""Tidemark: a time-series analytics engine on Spark DataFrames."""
