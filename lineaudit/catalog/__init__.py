"""Queries over the test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ranking", "comparisons", "corpora", "texts", "training", "surfaces", "exchange")


def registry():
    queries, oracle = {}, {}
    for name in MODULES:
        mod = import_module(f"lineaudit.catalog.{name}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle
