"""Registered queries and the SQL they are held against."""

from . import calls, records, roads, streams, words
from .registry import oracle_sql, queries

__all__ = ["calls", "oracle_sql", "queries", "records", "roads", "streams", "words"]
