"""Fuzzy membership degrees as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.functions.numeric import clamp01


def low(x: Column, t: float) -> Column:
    return clamp01(F.when(x <= t, 1 - x / F.lit(float(t))).otherwise(0.0))


def medium(x: Column, t: float) -> Column:
    return clamp01(F.when(x.between(0, 2 * t), 1 - F.abs(x - t) / F.lit(float(t))).otherwise(0.0))


def high(x: Column, t: float) -> Column:
    return clamp01(F.when(x >= t, (x - t) / F.lit(float(t))).otherwise(0.0))


def very_high(x: Column, t: float) -> Column:
    return clamp01(F.when(x >= 2 * t, (x - 2 * t) / F.lit(float(t))).otherwise(0.0))


def log_degree(x: Column, cap: float = 1.0) -> Column:
    """min(cap, ln(1+x)/10) for positive values, else 0."""
    return F.when(x > 0, F.least(F.lit(cap), F.log1p(x) / 10)).otherwise(0.0)


def rate_degrees(x: Column) -> dict[str, Column]:
    return {
        "high": F.when(x > 1000, clamp01((x - 1000) / 1000)).otherwise(0.0),
        "medium": F.when(x.between(100, 1000), clamp01((x - 100) / 900)).otherwise(0.0),
        "low": F.when(x < 100, F.least(F.lit(1.0), x / 100)).otherwise(0.0),
    }


def duration_degrees(x: Column) -> dict[str, Column]:
    return {
        "short": F.when(x < 1, F.least(F.lit(1.0), 1 - x)).otherwise(0.0),
        "normal": F.when(x.between(1, 10), clamp01((10 - x) / 9)).otherwise(0.0),
    }


def degrees(feature: str, x: Column) -> dict[str, Column]:
    """All membership degrees of one feature value."""
    x = x.cast("double")
    out = {"high": log_degree(x), "medium": log_degree(x, 0.6), "low": log_degree(x, 0.3)}
    if feature in ("packets_per_second", "bytes_per_second"):
        out.update(rate_degrees(x))
    elif feature == "flow_duration":
        out.update(duration_degrees(x))
    elif feature == "total_flags":
        out["high"] = F.when(x > 5, clamp01((x - 5) / 5)).otherwise(0.0)
    else:
        out["normal"] = F.lit(1.0)
    return out
