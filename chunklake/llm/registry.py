"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES, and ORACLE_SQL where there is any.
MODULES = ("bpe", "urls", "simhash", "quality", "toxicity", "contamination", "lines", "brown", "suffixes", "counts")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"chunklake.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
