"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from scarpline.plans import datasets, points, regions, terrain

_MODULES = (points, terrain, regions, datasets)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
