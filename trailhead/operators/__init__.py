"""Operators over domain tables; each takes and returns DataFrames."""
