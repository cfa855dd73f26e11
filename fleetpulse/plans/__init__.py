"""Mining of execution plans kept as EXPLAIN-style JSON."""
