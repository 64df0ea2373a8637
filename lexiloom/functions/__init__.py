"""Column functions: stateless, so they work on batch and on streaming DataFrames alike."""
