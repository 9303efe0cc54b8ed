"""Registered queries: each reads the supplied tables and names its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id; ``sql`` is the DuckDB twin."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    from flowlens.queries import (  # noqa: F401
        aggregates, alerting, features, learning, patterns, rules, sampling, scans, selection, streams, verification,
    )
