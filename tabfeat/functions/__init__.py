"""Column expressions and a few scalar helpers for results that are one row each."""
