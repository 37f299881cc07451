"""Operators for preparing language-model training data at corpus scale.

Nothing else in the library imports this package. Each module holds one
operator with its own general interface; ``queries`` holds the registered
queries and their SQL.
"""
