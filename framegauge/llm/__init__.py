"""Operators for preparing training data: tokens, packing, near-duplicates, filters."""
