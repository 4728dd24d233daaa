"""Queries over the test tables, each beside the SQL that gives the same result."""

from . import analytics, auctions, matching, retail, rows, streams, written
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "auctions", "matching", "retail", "rows", "streams", "written"]
