"""cuelake plans."""
