"""Operators of a training-data pipeline.

Self-contained: nothing else in the library imports this package.
"""
