"""Text indexing, search and corpus analytics on DataFrames."""
