"""Structured Streaming forms of the frame-local operators."""
