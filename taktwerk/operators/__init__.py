"""Operators of the transit delay engine."""
