"""Operators of training-data pipelines on Spark DataFrames."""
