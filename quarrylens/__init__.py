"""Profiling, quality, relationship, catalog, search and masking jobs on Spark DataFrames."""
