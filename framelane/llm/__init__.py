"""Operators for training-data pipelines: near-duplicates, personal data, filters, tokens, mixing and sharding."""
