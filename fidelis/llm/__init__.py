"""Operators that prepare text for training language models.

Nothing outside this subpackage (and the pipeline at the top of the repository) imports it.
Each operator has a module of its own; ``queries`` registers one query for each of them.
"""
