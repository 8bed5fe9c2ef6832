"""Registered queries: every operator applied to the given tables, with SQL to check it."""

from importlib import import_module

MODULES = [
    "season_queries", "ranking_queries", "join_queries", "scalar_queries", "roster_queries",
    "ledger_queries", "document_queries", "name_queries", "feed_queries", "table_queries", "league_queries",
]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
