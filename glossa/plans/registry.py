"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all():
    # importing the plan modules fills the registry
    from glossa.plans import (  # noqa: F401
        q_text, q_refine, q_align, q_stats, q_eval, q_models, q_class, q_panels, q_wide)
    return QUERIES, ORACLE
