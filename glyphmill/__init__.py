"""Text-template, near-duplicate and graph analytics on PySpark."""
