"""Structured Streaming twins of the batch state jobs."""
