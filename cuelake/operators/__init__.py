"""cuelake operators."""
