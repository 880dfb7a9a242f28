"""End-to-end studies and the registered query catalog."""
