"""Football results and odds analytics on Spark DataFrames."""
