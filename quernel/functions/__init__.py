"""Column expressions and the syntax pass."""
