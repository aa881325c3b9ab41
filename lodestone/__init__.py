"""Declared-path analytics on Spark DataFrames."""
