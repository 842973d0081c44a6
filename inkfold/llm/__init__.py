"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; it imports nothing of the rest of
the library, so either half can be removed.
"""
