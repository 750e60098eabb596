"""Structured Streaming forms of what arrives month by month."""
