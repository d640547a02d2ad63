"""Operators of a training-data pipeline: find, score, match, mix and encode documents.

Nothing else in the library imports this subpackage. Each operator takes and returns
DataFrames; ``registry`` holds the queries over the test tables and their SQL.
"""
