"""Column expressions: geometry, text, time and encoding."""
