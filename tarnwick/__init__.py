"""Measurement-to-score analytics on Spark DataFrames."""
