"""Operators for training-data pipelines: each takes and returns DataFrames."""
