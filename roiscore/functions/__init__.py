"""Column expressions and numpy helpers."""
