"""Search, compare and aggregate protected tables with Spark DataFrames."""
