"""Sources of ledgerleaf."""
