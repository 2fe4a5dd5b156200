"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
Every operator takes and returns DataFrames; Python runs inside tasks over Arrow batches.
"""
