"""Structured Streaming forms of the trajectory operators."""
