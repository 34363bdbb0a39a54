"""Incremental maintenance of the cell index by Structured Streaming."""
