"""Operators of a large training-data pipeline.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names and returns a DataFrame; ``queries`` binds the
operators to the test tables.
"""
