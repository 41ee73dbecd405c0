"""Operators for preparing training data: formatting, deduplication, sharding, filtering, tokenisation and packing."""
