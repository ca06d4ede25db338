"""Operators: DataFrames in, DataFrames out, no actions in between unless a docstring says so."""
