"""Operators for building large language-model training corpora.

Nothing else in the library imports this subpackage; queries are in ``queries``.
"""
