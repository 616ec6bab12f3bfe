"""Spatial-graph sampling and analytics on Spark DataFrames."""
