"""Column helpers used by the operators."""
