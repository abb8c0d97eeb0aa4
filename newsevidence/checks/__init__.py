"""Checked queries: every operator over the supplied tables, next to the SQL that must agree.

Importing the modules fills the registry; ``queries()`` and ``oracles()`` read it.
"""

from __future__ import annotations

from importlib import import_module

from .registry import oracles, queries  # noqa: F401

for _name in ("texts", "chunks", "hits", "web", "feeds", "catalog", "runs", "articles", "claims"):
    import_module(f"{__name__}.{_name}")
