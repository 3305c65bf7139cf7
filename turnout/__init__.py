"""Participation analytics on Spark DataFrames."""
