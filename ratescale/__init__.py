"""Ratings, model responses and descriptive phrases analysed with Spark DataFrames."""
