"""Ordered record streams, the findings made about them, and large collections of text, on PySpark."""
