"""Operators of a training-data pipeline: archives, filters, deduplication, packing, sharding.

Nothing else in the library imports this subpackage.
"""
