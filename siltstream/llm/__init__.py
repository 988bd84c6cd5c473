"""Operators for large collections of text. Nothing outside this package imports it."""
