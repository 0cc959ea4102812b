"""folioflow: ordered pages of text, taken apart and audited with Spark."""
