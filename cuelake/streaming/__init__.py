"""cuelake streaming."""
