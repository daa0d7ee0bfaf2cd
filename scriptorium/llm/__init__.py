"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and returns a DataFrame; the thin benchmark queries are in ``queries``.
"""
