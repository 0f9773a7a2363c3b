"""functions of the gridded engine."""
