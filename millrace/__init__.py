"""millrace: batch map / shuffle / reduce on Spark DataFrames."""
