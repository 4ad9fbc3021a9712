"""Operators over the map model."""
