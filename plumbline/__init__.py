"""Evidence auditing and training-data operators on Spark DataFrames."""
