"""streaming of the gridded engine."""
