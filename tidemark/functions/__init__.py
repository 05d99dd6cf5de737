"""Column and range functions."""
