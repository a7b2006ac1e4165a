"""Operators for preparing training data: filters, search, deduplication, mixing and packing."""
