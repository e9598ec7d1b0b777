"""Operators for large training-data pipelines.

Nothing outside this folder imports from it but the registry at the repository top.
"""
