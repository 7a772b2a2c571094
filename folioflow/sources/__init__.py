"""Readers of page documents and their codecs."""
