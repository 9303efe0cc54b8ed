"""Numeric column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

EPS = 1e-8


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def finite_or_null(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    ratio = F.try_divide(a, b)
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def zscore(c: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(c - mean, std)


def non_null_count(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def row_sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def row_mean(cols: list[Column]) -> Column:
    return F.try_divide(row_sum(cols), non_null_count(cols))


def row_std_samp(cols: list[Column]) -> Column:
    """Sample deviation over the non-null columns of one row."""
    mean = row_mean(cols)
    squares = row_sum([(c.cast("double") - mean) * (c.cast("double") - mean) for c in cols])
    n = non_null_count(cols)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def shannon_shares(cols: list[Column]) -> Column:
    """Shannon entropy of each column's share of the row total.

    Shares are clipped to [1e-12, 1] and the total carries an epsilon, so an
    all-zero row has a defined value.
    """
    parts = [F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) for c in cols]
    total = reduce(lambda a, b: a + b, parts) + F.lit(EPS)
    shares = [F.least(F.lit(1.0), F.greatest(F.lit(1e-12), p / total)) for p in parts]
    return -reduce(lambda a, b: a + b, [s * F.log2(s) for s in shares])


def wald_margin(p: Column, n: Column) -> Column:
    """Half width of the 95% Wald interval, 0 where there are no samples."""
    return F.when(n > 0, F.lit(1.96) * F.sqrt(p * (1 - p) / n)).otherwise(F.lit(0.0))
