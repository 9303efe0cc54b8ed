"""One-row statistics used by row-level expressions.

Batch plans take them as an uncorrelated scalar subquery: Spark runs the
aggregate once, injects the value as a literal, and no join is planned.
Streaming plans take them from a fitted row (``fit``), because a stream has no
global aggregate.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window, functions as F


def lazy(df: DataFrame, **aggs: Column) -> Column:
    """Struct column holding the aggregates of ``df``."""
    fields = [c.alias(name) for name, c in aggs.items()]
    return df.agg(F.struct(*fields).alias("s")).scalar()


def fit(df: DataFrame, **aggs: Column) -> dict[str, Any]:
    """The same aggregates as plain numbers: one row, whatever the input size."""
    row: Row = df.agg(*[c.alias(name) for name, c in aggs.items()]).first()
    return row.asDict()


def stat(stats: Column | dict[str, Any], name: str) -> Column:
    return F.lit(stats[name]) if isinstance(stats, dict) else stats[name]


def moments(columns: list[str]) -> dict[str, Column]:
    """mean/std/min/max of every column as one aggregate."""
    out: dict[str, Column] = {}
    for c in columns:
        out[f"{c}__mean"] = F.avg(c)
        out[f"{c}__std"] = F.stddev_samp(c)
        out[f"{c}__std_pop"] = F.stddev_pop(c)
        out[f"{c}__min"] = F.min(c)
        out[f"{c}__max"] = F.max(c)
    return out


def over_all(c: Column) -> Column:
    """An aggregate over all rows of an already aggregated, small table.

    Unlike a scalar subquery it does not read the source a second time.
    """
    return c.over(Window.partitionBy(F.lit(0)))
