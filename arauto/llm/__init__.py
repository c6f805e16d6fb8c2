"""Operators for training-data pipelines: sharding, mixing, joins on shingles, language, fingerprints, dedup, pages, tokens."""
