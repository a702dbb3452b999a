"""Operators for building large training corpora; nothing outside this subpackage imports it."""
