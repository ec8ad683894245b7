"""Operators for preparing training data for language models.

Nothing else in the package imports this subpackage; it can be removed as a
whole.
"""
