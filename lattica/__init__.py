"""Recursive and relational analytics on Spark DataFrames."""
