"""Plans of the scene-analytics engine."""
