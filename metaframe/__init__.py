"""Schema-driven metadata processing on Spark DataFrames."""
