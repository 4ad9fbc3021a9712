"""Streams of map extracts."""
