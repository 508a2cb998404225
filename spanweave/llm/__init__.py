"""Operators for building language-model training corpora.

Nothing outside this package imports it.  Every operator takes DataFrames and returns a
DataFrame; `queries.py` holds the registered queries and their SQL.
"""
