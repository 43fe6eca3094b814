"""Operators for large text and sensor corpora; nothing else in the library imports this package."""
