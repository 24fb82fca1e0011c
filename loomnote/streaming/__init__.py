"""Streams of commits and events with Structured Streaming."""
