"""Deterministic pseudo-random numbers derived from row keys.

md5 gives the same order on every engine and under every partitioning, so a
sample or split can be reproduced after executors are lost and recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def key_hash(key: Column, seed: int) -> Column:
    """32 hex digits, uniform in the key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def hash_bucket(h: Column, digits: int = 4) -> Column:
    """Leading hex digits as a number below 16**digits."""
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("bigint")


def hash_uniform(h: Column) -> Column:
    """Uniform double in [0, 1) from the first 8 hex digits."""
    return hash_bucket(h, 8).cast("double") / F.lit(float(16**8))
