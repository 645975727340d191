"""Structured Streaming: the same extraction over a folder that pages land in."""
