"""Column expressions: pure builders, no jobs."""
