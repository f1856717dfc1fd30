"""Column-level building blocks: comparison operators and aggregate functions."""
