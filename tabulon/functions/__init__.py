"""Functions of the list engine."""
