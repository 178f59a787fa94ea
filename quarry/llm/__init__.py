"""Operators of a training-data pipeline: deduplication, filtering, scanning and packing.

Nothing outside this subpackage imports it.
"""
