"""Incremental daily counts with Structured Streaming."""
