"""Operators of the scene-analytics engine."""
