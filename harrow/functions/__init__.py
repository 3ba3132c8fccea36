"""functions of the recruitment engine."""
