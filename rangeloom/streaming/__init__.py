"""Streams into bags."""
