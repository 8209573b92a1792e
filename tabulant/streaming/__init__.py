"""Chunked reading and running profiles on Structured Streaming."""
