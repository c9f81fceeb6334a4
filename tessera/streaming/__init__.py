"""Streaming counterparts of cache lookups; the batch operators are in ``tessera.operators``."""
