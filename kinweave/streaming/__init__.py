"""Incremental linking with Structured Streaming."""
