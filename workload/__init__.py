"""How the given tables play the roles of a store, and the queries registered on them."""

from __future__ import annotations

import importlib

from workload.registry import ENTRIES, Entry

MODULES = ("retrieval", "tables", "text", "search", "changes", "evaluation", "sealed", "streams", "stored")


def all_entries() -> dict[str, Entry]:
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return ENTRIES
