"""docloom: document-knowledge jobs on Spark (DataFrames in, DataFrames out)."""
