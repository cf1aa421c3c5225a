"""Structured Streaming: log replay, flushing, rate limiting."""
