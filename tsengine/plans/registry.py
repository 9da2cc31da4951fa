"""The registered queries of the time-series library and their DuckDB SQL."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
