"""chunklake: chunk-pruned columnar analytics on Spark DataFrames."""
