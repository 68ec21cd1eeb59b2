"""Operators that prepare language-model training data, with their queries.

Nothing outside this subpackage imports it.
"""
