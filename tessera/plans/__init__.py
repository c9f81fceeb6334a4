"""Named queries over the driver's tables, with their SQL."""

from __future__ import annotations

import importlib

from tessera.plans.registry import QUERIES, SQL, Query

MODULES = ("text_queries", "retrieval_queries", "evidence_queries", "lab_queries", "graph_queries", "cache_queries", "other_queries", "more_queries", "web_queries", "eval_queries", "file_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return QUERIES


def all_sql() -> dict[str, str]:
    _load()
    return SQL
