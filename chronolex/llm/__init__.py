"""Operators that prepare training text: deduplication, mixing, sharding, tokens, quality, markup and media."""
