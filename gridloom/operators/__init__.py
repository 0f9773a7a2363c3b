"""operators of the gridded engine."""
