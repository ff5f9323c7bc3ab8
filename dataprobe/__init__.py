"""Data profiling and bulk matching on Spark DataFrames."""
