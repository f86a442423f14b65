"""Operators for preparing training data for language models.

Nothing else in the library imports this subpackage.
"""
