"""Structured Streaming jobs over the observation log."""
