"""Batch analytics over agent memory tables, on Spark DataFrames."""
