"""Functions of ledgerleaf."""
