"""Where source files come from."""
