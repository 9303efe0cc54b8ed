"""Text expressions for substring scans."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def quote(pattern: str) -> str:
    r"""A literal pattern as a Java regex (``\Q..\E``)."""
    return "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def overlaps_itself(pattern: str) -> bool:
    """True when an occurrence can start inside another one (``aba`` in ``ababa``)."""
    return any(pattern.startswith(pattern[i:]) for i in range(1, len(pattern)))


def occurrences(text: Column, pattern: str) -> Column:
    """Number of occurrences including overlapping ones.

    A pattern that cannot overlap itself is counted by the bytes its removal
    saves, which is a plain search; only the others need a look-ahead regex.
    """
    if overlaps_itself(pattern):
        return F.regexp_count(text, F.lit(f"(?={quote(pattern)})"))
    saved = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(pattern), F.lit("")))
    return (saved / F.lit(len(pattern.encode("utf-8")))).cast("int")


def with_chunks(df: DataFrame, text_col: str, overlap: int, size: int = 4096) -> DataFrame:
    """One row per text slice: ``chunk_start``, ``chunk`` (slice plus ``overlap``
    following characters) and ``chunk_len`` (slice only).

    Every position of the text starts in exactly one slice and every window of
    ``overlap + 1`` characters lies inside the row of its start, so a scan per
    slice is a scan of the whole text; cost is linear in the text length.
    """
    size = max(size, overlap)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit("(?s).{1,%d}" % size), F.lit(0))
    keep = [c for c in df.columns if c != text_col]
    tail = F.left(F.coalesce(F.get("__pieces", F.col("__i") + 1), F.lit("")), F.lit(overlap))
    return (
        df.withColumn("__pieces", pieces)
        # The outer form keeps Spark from repeating the slicing in an inferred filter.
        .select(*keep, "__pieces", F.posexplode_outer("__pieces").alias("__i", "__piece"))
        .filter(F.col("__piece").isNotNull())
        .select(
            *keep,
            (F.col("__i") * F.lit(size)).cast("bigint").alias("chunk_start"),
            F.concat("__piece", tail).alias("chunk") if overlap else F.col("__piece").alias("chunk"),
            F.length("__piece").alias("chunk_len"),
        )
    )


def fill(template: str, **values: Column) -> Column:
    """A text with ``{name}`` replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [values[part] if k % 2 else F.lit(part) for k, part in enumerate(parts) if k % 2 or part]
    return F.concat(*pieces)
