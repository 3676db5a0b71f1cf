"""Operators by subject; each takes and returns columns or DataFrames."""
