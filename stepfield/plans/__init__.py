"""Registered queries: operator pipelines over the test tables, each with its SQL twin."""
