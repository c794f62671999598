"""Column expressions: text and date rules."""
