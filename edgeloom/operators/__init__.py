"""Operators over an edge table. Each takes and returns DataFrames; none collects rows."""
