"""Column expressions and text parsers."""
