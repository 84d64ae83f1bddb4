"""All core queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text", "dedup", "vectors", "queries", "pages", "changes")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _m = import_module(f"sparrowdex.plans.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
