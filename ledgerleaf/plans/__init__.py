"""Plans of ledgerleaf."""
