"""streaming of fieldwave."""
