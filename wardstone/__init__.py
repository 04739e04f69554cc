"""Security-log normalisation and corpus processing on Spark DataFrames."""
