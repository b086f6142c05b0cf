"""Passages as a stream."""
