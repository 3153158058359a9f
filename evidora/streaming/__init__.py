"""Structured Streaming jobs over message and event streams."""
