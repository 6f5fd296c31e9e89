"""streaming of the temporal feature engine."""
