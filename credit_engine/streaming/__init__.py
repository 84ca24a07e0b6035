"""Structured Streaming versions of time-windowed operators."""
