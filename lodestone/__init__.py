"""Vector search and analytics on Spark DataFrames."""
