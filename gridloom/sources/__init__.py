"""sources of the gridded engine."""
