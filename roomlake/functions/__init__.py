"""Functions of the scene-analytics engine."""
