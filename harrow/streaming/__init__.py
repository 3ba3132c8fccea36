"""streaming of the recruitment engine."""
