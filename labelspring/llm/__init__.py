"""Operators of a training-data pipeline: filtering, deduplication, packing, output.

Each module holds one operator with its general interface; ``catalog`` registers
the queries.  Nothing outside this package imports it.
"""
