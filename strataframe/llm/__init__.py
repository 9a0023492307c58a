"""Training-data operators: deduplication, mixing, packing, search, token files, filters.

Nothing outside this folder imports it.
"""
