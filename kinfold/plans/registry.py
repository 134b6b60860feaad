"""All registered queries and their SQL statements."""

from __future__ import annotations

from kinfold.plans import (
    article_queries,
    batch_queries,
    encoder_queries,
    file_queries,
    fit_queries,
    mining_queries,
    run_queries,
    similarity_queries,
)

_MODULES = (
    article_queries,
    mining_queries,
    similarity_queries,
    batch_queries,
    encoder_queries,
    fit_queries,
    file_queries,
    run_queries,
)


def queries() -> dict:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
