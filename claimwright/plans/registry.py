"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from claimwright.plans import (  # noqa: F401
        queries_corpus,
        queries_eval,
        queries_features,
        queries_files,
        queries_jobs,
        queries_streaming,
        queries_text,
    )
