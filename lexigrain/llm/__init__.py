"""Operators for preparing training data: quality, languages, duplicates, tokens, packing."""
