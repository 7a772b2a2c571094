"""Streaming change feeds and sessions."""
