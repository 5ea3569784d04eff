"""The row-local operators on streaming DataFrames."""
