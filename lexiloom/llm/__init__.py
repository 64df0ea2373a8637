"""Operators for training-data pipelines: deduplication, privacy, scoring, sharding, search, packing and encoding."""
