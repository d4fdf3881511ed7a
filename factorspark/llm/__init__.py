"""Operators of a training-data pipeline: extraction, deduplication, search, sharding, mixing, filters, tokenizing.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
