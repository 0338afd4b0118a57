"""Registered queries and their SQL counterparts."""

from importlib import import_module

MODULES = ("vectors", "fusion", "sources", "rules", "evaluation", "flows")


def load():
    from nodeflow.queries import base

    for name in MODULES:
        import_module(f"nodeflow.queries.{name}")
    return base.QUERIES, base.ORACLES
