"""fieldwave: Spark jobs over collections of electric-signal recordings."""
