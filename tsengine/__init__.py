"""A time-series analytics library on Spark DataFrames."""
