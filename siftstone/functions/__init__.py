"""Column functions and the Python functions that have no built-in counterpart."""
