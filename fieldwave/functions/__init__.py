"""functions of fieldwave."""
