"""Training-data operators. Nothing outside this folder imports it, except __spark_entry__.py behind a guard."""
