"""Structured Streaming over field observations and events."""
