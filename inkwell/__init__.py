"""Manuscript analytics on Spark: jobs from DataFrames to DataFrames."""
