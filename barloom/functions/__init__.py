"""Column expressions: scalars and windows."""
