"""cuelake sources."""
