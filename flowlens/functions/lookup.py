"""Fixed dictionaries as columns and as literal tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def map_literal(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value for ``key`` in a fixed dictionary, as an expression (no join)."""
    value = F.try_element_at(map_literal(mapping), key)
    return value if default is None else F.coalesce(value, F.lit(default))


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table built on the JVM side; its size is the size of ``rows``."""

    def lit(v):
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    structs = [F.struct(*[lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
