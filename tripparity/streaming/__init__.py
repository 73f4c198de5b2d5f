"""Structured Streaming jobs reusing the batch operators unchanged."""
