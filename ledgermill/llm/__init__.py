"""Operators of a training-data pipeline: fingerprints, language, quality, deduplication, decontamination, sharding, packing."""
