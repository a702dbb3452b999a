"""Incremental runs of the same queries."""
