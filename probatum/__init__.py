"""Tabular data-quality audit and leakage-safe model evaluation on Spark DataFrames."""
