"""cuelake: timed-text analytics on Spark DataFrames and streams."""
