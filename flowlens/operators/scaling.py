"""Scaling and imputation from one aggregate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions import stats as st
from flowlens.functions.quantile import exact_quantiles


def _stat_exprs(df: DataFrame, columns: list[str], impute: bool, approx: bool) -> dict[str, Column]:
    exprs = st.moments(columns)
    if impute and approx:
        for c in columns:
            exprs[f"{c}__median"] = F.percentile_approx(c, 0.5, 10_000).cast("double")
    elif impute:
        exact = exact_quantiles(df, {c: [0.5] for c in columns})
        for c in columns:
            exprs[f"{c}__median"] = F.lit(exact[c, 0.5]).cast("double")
    return exprs


def fit_scaler(df: DataFrame, columns: list[str], impute: bool = False, approx: bool = False) -> dict[str, Any]:
    """Fitted numbers as a dict (one row to the driver); medians are exact unless ``approx``."""
    return st.fit(df, **_stat_exprs(df, columns, impute, approx))


def lazy_scaler(df: DataFrame, columns: list[str], impute: bool = False, approx: bool = False) -> Column:
    """The same numbers inside the plan; only exact medians are found beforehand, in bounded memory."""
    return st.lazy(df, **_stat_exprs(df, columns, impute, approx))


def scale(df: DataFrame, columns: list[str], stats: Column | dict[str, Any], method: str = "minmax",
          impute: bool = False) -> DataFrame:
    """Min-max to [0, 1] or standard score with the population deviation.

    A constant column becomes 0.
    """
    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        if impute:
            x = F.coalesce(x, st.stat(stats, f"{c}__median"))
        if method == "minmax":
            lo, hi = st.stat(stats, f"{c}__min"), st.stat(stats, f"{c}__max")
            y = F.try_divide(x - lo, (hi - lo).cast("double"))
        elif method == "standard":
            y = F.try_divide(x - st.stat(stats, f"{c}__mean"), st.stat(stats, f"{c}__std_pop"))
        else:
            raise ValueError(f"unknown scaling method {method}")
        return F.when(x.isNotNull(), F.coalesce(y, F.lit(0.0)))

    return df.withColumns({c: one(c) for c in columns})
