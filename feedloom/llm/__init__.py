"""Operators of a training-data pipeline over the tables ``documents`` and ``pages``.

Nothing else in the package imports this subpackage.  Each operator takes DataFrames and
column names, reads only the columns it names (so other columns may be called anything)
and returns a DataFrame; ``catalog`` holds the registered queries and their SQL.
"""
