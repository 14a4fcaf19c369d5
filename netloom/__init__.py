"""Network-graph analytics on Spark DataFrames."""
