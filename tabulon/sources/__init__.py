"""Sources of the list engine."""
