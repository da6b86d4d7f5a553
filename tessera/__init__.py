"""Column profiling, semantic typing and corpus preparation on Spark DataFrames."""
