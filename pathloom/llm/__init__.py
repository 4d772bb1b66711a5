"""Operators for preparing training data: cleaning, deduplication, tokens and packing."""
