"""All registered queries."""

from __future__ import annotations

import importlib

_MODULES = ["notices", "text", "structure", "retrieval", "evaluation", "dialogue", "operations", "plans"]


def registered() -> dict:
    """name -> (query, oracle SQL or None)."""
    found: dict = {}
    for module in _MODULES:
        entries = importlib.import_module(f"tenderloom.workload.{module}").QUERIES
        assert not found.keys() & entries.keys()
        found.update(entries)
    return found
