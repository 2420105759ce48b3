"""Training-data operators: deduplication, filtering, tokenisation, search, packing and archives.

Nothing outside this subpackage imports it.
"""
