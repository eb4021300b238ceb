"""Column expressions and binary parsers."""
