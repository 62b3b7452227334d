"""Operators for building training corpora: packing, deduplication, mixing, scanning, archives.

Nothing outside this package imports it.
"""
