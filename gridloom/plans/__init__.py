"""plans of the gridded engine."""
