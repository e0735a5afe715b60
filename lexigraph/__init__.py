"""Search, text clustering and page extraction on Spark DataFrames."""
