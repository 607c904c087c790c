"""Structured Streaming: the incremental pipeline over a folder of changes."""
