"""Column building blocks."""
