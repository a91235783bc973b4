"""Operators of a training-data pipeline: fingerprints, dedup, models, tokens and packing."""
