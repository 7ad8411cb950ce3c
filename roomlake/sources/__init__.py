"""Sources of the scene-analytics engine."""
