"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; it can be removed as a whole.
Each module holds one operator with its own general interface; ``queries`` holds the thin
registered queries and ``oracles`` the SQL that some of them can be held against.
"""
