"""Structured Streaming scoring of newly arriving answers."""
