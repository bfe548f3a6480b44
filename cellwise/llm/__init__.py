"""Operators for preparing training corpora: packing, sharding, archives, filters, deduplication."""
