"""Column expressions: paths, text, JSON and line structure."""
