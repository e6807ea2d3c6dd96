"""Streams of responses."""
