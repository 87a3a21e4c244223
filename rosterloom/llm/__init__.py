"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator with a general interface;
``queries.py`` holds the thin registered queries, ``sql.py`` their SQL.
"""
