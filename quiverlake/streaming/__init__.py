"""Structured Streaming in front of the update path."""
