"""Operators that prepare text corpora for model training.

Nothing outside this package imports it.  Each operator module has a general
interface over any documents table; ``queries`` holds the thin registered
queries and ``oracles`` their SQL.
"""
