"""Clustering-consistency analytics on Spark DataFrames."""
