"""Registered queries: each applies an operator to the given tables and has, where possible, equal SQL."""
