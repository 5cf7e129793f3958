"""ledgerleaf: analytics over long financial disclosures, written as Spark DataFrame plans."""
