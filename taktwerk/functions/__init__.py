"""Functions of the transit delay engine."""
