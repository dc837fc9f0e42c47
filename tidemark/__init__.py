"""tidemark: change-data-capture analytics on Spark DataFrames."""
