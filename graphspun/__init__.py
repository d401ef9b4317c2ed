"""Graph-shaped analytics on Spark DataFrames."""
