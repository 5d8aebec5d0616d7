"""SQL equivalents of the registered queries, for checking results."""
