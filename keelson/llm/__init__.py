"""Operators for training-data pipelines (documents, pages, conversations).

Nothing else in the package imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` holds the thin registered
queries that derive the digest columns from the operators' outputs.
"""
