"""Operators, each with the queries that apply it to the test tables."""

import importlib

MODULES = ("series_queries", "claims", "checkers", "metrics", "joins", "retrieval", "reports", "plan_queries", "blocks", "scoring", "baselines", "realcaption", "generate", "artifacts", "streams")


def load() -> None:
    """Registers the queries of all modules."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
