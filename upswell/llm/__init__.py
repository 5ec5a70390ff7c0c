"""Operators for preparing training text: deduplication, filters, archives, mixing and sharding."""
