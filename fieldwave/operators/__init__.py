"""operators of fieldwave."""
