"""operators of siltworks."""
