"""Column expressions used by the operators."""
