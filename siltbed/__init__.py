"""Log-structured tables on Spark DataFrames."""
