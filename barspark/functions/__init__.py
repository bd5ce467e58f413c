"""Column functions and windows."""
