"""Operators for preparing training data: scoring, deduplication, extraction, tokens, packing, search."""
