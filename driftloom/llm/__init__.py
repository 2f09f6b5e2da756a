"""Training-data operators: deduplication, tokenisation, quality, safety, sharding and packing.

The package is self-contained: nothing outside it imports it, and it may be
deleted without touching the rest of the library.
"""
