"""Operators for training-data pipelines: mixing, packing, token files, quality, dedup, search, language."""
