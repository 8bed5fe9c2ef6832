"""Queries of the training-data operators and, where SQL can state the result, their SQL."""

from __future__ import annotations

from importlib import import_module

from seasonframe.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULES = ["native_queries", "scan_queries", "dedup_queries", "page_queries", "vector_queries", "conversation_queries"]


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load_all() -> None:
    for name in MODULES:
        import_module(f"seasonframe.llm.{name}")
