"""Operators for preparing training data: scoring, deduplication, mixing, search, storage formats."""
