"""plans of the temporal feature engine."""
