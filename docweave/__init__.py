"""Batch retrieval and response-quality analytics over document tables, on Spark DataFrames."""
