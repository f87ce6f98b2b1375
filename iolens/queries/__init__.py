"""Named queries: one per operator of the inventory.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``.
The SQL is DuckDB text over the driver's tables; it re-derives the same trace
view and computes the answer independently (plain window functions and
aggregates on one machine). Entries without SQL are checked by tests.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

_MODULES = ("scalars", "aggregates", "windows", "access", "sources", "models", "cells")


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load():
    for m in _MODULES:
        try:
            importlib.import_module(f"iolens.queries.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"iolens.queries.{m}":
                raise


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
