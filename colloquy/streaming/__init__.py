"""Structured Streaming jobs; each also runs on a bounded frame with the same result."""
