"""cuelake functions."""
