"""Query catalogue: Spark plans per operator and their SQL restatements."""
