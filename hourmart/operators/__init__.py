"""Relational operators: each takes and returns DataFrames, parametric in the panel."""
