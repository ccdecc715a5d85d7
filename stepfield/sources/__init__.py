"""Readers and writers of location tables."""
