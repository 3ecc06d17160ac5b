"""Training-data operators: search, scoring, deduplication, formatting, packing.

Nothing outside this subpackage imports it.
"""
