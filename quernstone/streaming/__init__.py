"""Incremental forms of the counts, for inputs that keep arriving."""
