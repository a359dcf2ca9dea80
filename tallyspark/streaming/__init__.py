"""Polling as Structured Streaming."""
