"""operators of the recruitment engine."""
