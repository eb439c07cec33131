"""graphloom: triple-graph analytics on Spark DataFrames."""
