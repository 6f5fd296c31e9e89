"""operators of the temporal feature engine."""
