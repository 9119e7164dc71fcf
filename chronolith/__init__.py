"""Time-series and tensor analytics on Spark DataFrames."""
