"""The queries over the driver's tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from . import file_queries, index_queries, result_queries, stream_queries, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
