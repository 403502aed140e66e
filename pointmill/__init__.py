"""Point analytics on Spark DataFrames."""
