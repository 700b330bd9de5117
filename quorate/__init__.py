"""Attempt and transcript analytics on Spark DataFrames."""
