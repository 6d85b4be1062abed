"""Streaming of the list engine."""
