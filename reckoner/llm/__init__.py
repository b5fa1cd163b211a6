"""Operators for large training corpora: cleaning, deduplication, search, mixing and packing."""
