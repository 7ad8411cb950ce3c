"""Streaming of the scene-analytics engine."""
