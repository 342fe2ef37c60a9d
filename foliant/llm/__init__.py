"""Training-data operators: deduplication, scoring, scans, packing and sharding of text tables.

Nothing outside this subpackage imports it.
"""
