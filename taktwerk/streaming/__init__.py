"""Streaming of the transit delay engine."""
