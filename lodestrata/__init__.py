"""Search, ranking and usage analytics over large text corpora, on Spark DataFrames."""
