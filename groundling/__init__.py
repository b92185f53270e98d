"""Spatial feature analytics on Spark DataFrames."""
