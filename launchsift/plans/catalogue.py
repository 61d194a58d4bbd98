"""All named queries."""

from __future__ import annotations

import importlib

from launchsift.plans.registry import Query

FLAGSHIP = "q00_score_tokens"
SECTIONS = ("intake", "signals", "verdicts", "store", "spend", "delivery", "health", "reading")


def all_queries() -> list[Query]:
    found = []
    for name in SECTIONS:
        found += importlib.import_module(f"launchsift.plans.{name}").section.queries
    return sorted(found, key=lambda q: q.name)
