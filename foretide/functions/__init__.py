"""functions of the temporal feature engine."""
