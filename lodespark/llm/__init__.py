"""Operators of a training-data pipeline: encoding, deduplication, decontamination, scoring, sharding, salvage."""
