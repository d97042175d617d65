"""streaming of siltworks."""
