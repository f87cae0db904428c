"""Operators for large training-corpus pipelines.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when the package can be imported.
"""
