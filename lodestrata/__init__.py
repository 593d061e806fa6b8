"""Discovery of structure in messy, heterogeneous data, on Spark DataFrames."""
