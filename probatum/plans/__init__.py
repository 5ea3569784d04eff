"""Composed reports, derived inputs and the query catalogue."""
