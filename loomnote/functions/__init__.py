"""Column functions and small pure-Python counterparts."""
