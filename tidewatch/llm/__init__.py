"""Operators for preparing training text: sharding, fingerprints, quality, secrets, tokens, packing."""
