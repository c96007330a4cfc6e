"""Content analytics, recommendation and document processing as Spark DataFrames."""
