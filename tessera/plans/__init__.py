"""End-to-end runs (arms) and the registered query catalog."""
