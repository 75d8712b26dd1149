"""Column functions and HTML functions."""
