"""sources of siltworks."""
