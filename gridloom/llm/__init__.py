"""Operators of a training-data pipeline: filtering, deduplication, scoring, packing and output."""
