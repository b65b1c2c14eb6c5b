"""Operators of a training-data pipeline: filters, deduplication, mixing, encoding, search, classifiers.

Every operator is a function from DataFrames to DataFrames. Nothing else in the library imports this package.
"""
