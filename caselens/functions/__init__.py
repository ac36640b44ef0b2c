"""Column expressions, fixed values and small DataFrame helpers."""
