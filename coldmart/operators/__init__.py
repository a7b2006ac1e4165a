"""DataFrame operators. Column names and thresholds are parameters; nothing runs eagerly."""
