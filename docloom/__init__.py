"""Document analytics on Spark: keyspaces, typed filters, change logs, merges."""
