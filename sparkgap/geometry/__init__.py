"""geometry of the engine."""
