"""tidegraph: change-impact analytics over dependency graphs, on Spark DataFrames."""
