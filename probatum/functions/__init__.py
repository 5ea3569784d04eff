"""Column expressions and small fixed tables."""
