"""Operators on large training corpora. Nothing outside this package imports it."""
