"""Operators for training-data pipelines over a corpus of documents.

Nothing outside this subpackage imports it.  ``registry`` lists the queries and
their DuckDB equivalents; each operator module also stands on its own.
"""
