"""Scalar expressions of the domain."""
