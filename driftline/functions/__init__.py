"""Column expressions: text analysis, name handling, small statistics."""
