"""Change monitoring and corpus analytics on Spark DataFrames."""
