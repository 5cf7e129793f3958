"""Operators of ledgerleaf."""
