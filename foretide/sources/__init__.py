"""sources of the temporal feature engine."""
