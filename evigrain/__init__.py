"""evigrain: evidence and document analytics on Spark DataFrames."""
