"""Registered queries, one per operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    # Importing the modules registers their queries.
    from weirline.plans import q_features, q_models, q_panel, q_screen, q_skill  # noqa: F401

    return QUERIES, ORACLE
