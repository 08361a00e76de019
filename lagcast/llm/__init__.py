"""Operators for training-data corpora: scoring, filtering, tokenising, packing, deduplicating, searching."""
