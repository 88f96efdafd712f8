"""Table profiling, validation, cleaning and statistical testing on Spark DataFrames."""
