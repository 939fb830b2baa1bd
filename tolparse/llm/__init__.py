"""Operators for preparing training data: extraction, filtering, deduplication, mixing and packing.

Nothing else in the library imports this subpackage; it can be removed without touching the rest.
"""
