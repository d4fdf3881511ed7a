"""Brute-force versions that several tests share."""
from test_dedup import exact, grouped, mark

__all__ = ["exact", "grouped", "mark"]
