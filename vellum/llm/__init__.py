"""Operators for preparing language-model training corpora.

Nothing else in ``vellum`` imports this package.
"""
