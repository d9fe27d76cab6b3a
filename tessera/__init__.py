"""A retrieval and analytics engine on Spark DataFrames."""
