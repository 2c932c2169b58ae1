"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``registry`` lists its
queries and the SQL that checks them.
"""
