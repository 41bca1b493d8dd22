"""Structured Streaming over a landing directory."""
