"""Operators of a training-data pipeline: extraction, filtering, dedup, packing.

Nothing else in the library imports this subpackage.
"""
