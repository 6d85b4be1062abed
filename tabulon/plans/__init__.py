"""Plans of the list engine."""
