"""Incremental aggregation with Structured Streaming."""
