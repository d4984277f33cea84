"""Column expressions: time keys, geometry, statistics, text."""
