"""functions of siltworks."""
