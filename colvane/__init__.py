"""Vector analytics on Spark: array operators, keyed tables, statistics and streams as DataFrame plans."""
