"""Documents, lines and partitions."""
