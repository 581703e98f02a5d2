"""Contract-governed relational analytics on Spark."""
