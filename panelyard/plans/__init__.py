"""Named queries over the driver tables."""

from importlib import import_module

from .registry import ORACLE, QUERIES

MODULES = ("flagship", "panel_queries", "factor_queries", "indicator_queries", "chart_queries",
           "fundamental_queries", "evaluation_queries", "portfolio_queries", "ledger_queries", "streaming_queries", "score_queries")


def _load():
    for m in MODULES:
        import_module(f"{__name__}.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(ORACLE)
