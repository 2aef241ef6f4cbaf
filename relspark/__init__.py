"""A relational analytics engine whose every operation is a lazily planned Spark DataFrame."""
