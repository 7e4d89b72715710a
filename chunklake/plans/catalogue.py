"""Every registered query of the engine, and its SQL text."""

from __future__ import annotations

from . import chunks, columns, ssb, tpch, trips

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in (ssb, tpch, trips, columns, chunks):
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
