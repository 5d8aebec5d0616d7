"""Structured Streaming forms of the health and registration flows."""
