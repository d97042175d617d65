"""plans of siltworks."""
