"""Tessella: integrated biclustering and matrix analytics on Spark DataFrames."""
