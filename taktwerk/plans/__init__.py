"""Plans of the transit delay engine."""
