"""Streaming of ledgerleaf."""
