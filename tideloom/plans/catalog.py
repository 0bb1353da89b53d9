"""All queries of the scheduler's operators; importing the modules registers them."""

from . import join_queries, scan_queries, stream_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
