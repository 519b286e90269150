"""Sources of the transit delay engine."""
