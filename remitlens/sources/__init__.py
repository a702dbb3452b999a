"""Readers of transfers, accounts and rates, and writers of results."""
