"""Operators of the list engine."""
