"""Operators of a training-data pipeline: deduplication, scoring, mixing, sharding, search, privacy and tokens."""
