"""Operators for building training corpora.

Nothing outside this subpackage imports it.  Each operator is a function from
DataFrames to DataFrames; ``queries`` registers one query for each of them.
"""
