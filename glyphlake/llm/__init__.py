"""Operators for preparing training corpora.

Each module holds one operator with a general interface; ``queries`` registers the thin
queries over the test tables.  Nothing outside this package imports it.
"""
