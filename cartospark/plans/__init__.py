"""Declarative parts: the map model, filters and feature specifications."""
