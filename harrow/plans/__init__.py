"""plans of the recruitment engine."""
