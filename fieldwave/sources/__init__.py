"""sources of fieldwave."""
