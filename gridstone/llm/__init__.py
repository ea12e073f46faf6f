"""Training-data operators: deduplication, search, archives, tokens, filters, sharding, packing.

Nothing outside this subpackage imports it.
"""
