"""Derived flow features as column expressions over one statistics row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from flowlens import fixed_values as fv
from flowlens.functions import numeric as nm, stats as st
from flowlens.sources.schema import numeric_columns

Stats = Column | dict[str, Any]

_STAT_COLUMNS = ["flow_duration", "packet_length_mean", "flow_bytes_per_s"]


def feature_stats(df: DataFrame) -> dict[str, Any]:
    """Fitted statistics for streaming or for a later run."""
    return st.fit(df, **st.moments([c for c in _STAT_COLUMNS if c in df.columns]))


def lazy_feature_stats(df: DataFrame) -> Column:
    return st.lazy(df, **st.moments([c for c in _STAT_COLUMNS if c in df.columns]))


def engineer(df: DataFrame, stats: Stats | None = None) -> DataFrame:
    """Every derived feature whose inputs exist; absent inputs are skipped."""
    stats = lazy_feature_stats(df) if stats is None else stats
    has = set(df.columns).__contains__
    new: dict[str, Column] = {}

    def standard(column: str) -> Column:
        return nm.zscore(F.col(column), st.stat(stats, f"{column}__mean"), st.stat(stats, f"{column}__std"))

    if has("flow_duration"):
        new["flow_duration_log"] = F.log1p(F.abs("flow_duration"))
        new["flow_duration_std"] = standard("flow_duration")
    if has("packet_length_mean"):
        new["packet_size_ratio"] = F.col("packet_length_mean") / (
            st.stat(stats, "packet_length_mean__max") + F.lit(nm.EPS))
        new["packet_size_std"] = standard("packet_length_mean")
    if has("flow_bytes_per_s"):
        new["bytes_per_sec_log"] = F.log1p(F.abs("flow_bytes_per_s"))
        new["bytes_per_sec_std"] = standard("flow_bytes_per_s")
    flags = [F.col(c).try_cast("double") for c in fv.FLAG_COLUMNS if has(c)]
    if flags:
        positive = [F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)) for c in flags]
        new["total_flags"] = nm.row_sum(positive)
        new["flag_entropy"] = nm.shannon_shares(flags)
    iats = [F.col(c) for c in fv.IAT_COLUMNS if has(c)]
    if iats:
        new["iat_mean"] = nm.row_mean(iats)
        new["iat_std"] = nm.row_std_samp(iats)
        new["iat_ratio"] = F.try_divide(nm.row_std_samp(iats), nm.row_mean(iats) + F.lit(nm.EPS))
    if has("src_port") and has("dst_port"):
        new["port_diff"] = F.abs(F.col("src_port") - F.col("dst_port"))
        new["is_well_known_src"] = F.col("src_port") <= 1024
        new["is_well_known_dst"] = F.col("dst_port") <= 1024
    return df.withColumns(new)


def flow_text(df: DataFrame) -> Column:
    """Flow as space-separated tokens; conditions that do not hold add nothing."""
    has = set(df.columns).__contains__
    parts: list[Column] = []
    if has("protocol"):
        parts.append(F.concat(F.lit("protocol_"), F.lower(F.col("protocol").cast("string"))))
    if has("src_port") and has("dst_port"):
        parts += [F.concat(F.lit(f"{c}_"), F.col(c).cast("string")) for c in ("src_port", "dst_port")]
    if has("flow_duration"):
        parts.append(F.when(F.col("flow_duration") < 1, "short_flow").when(F.col("flow_duration") > 3600, "long_flow"))
    if has("packet_length_mean"):
        parts.append(F.when(F.col("packet_length_mean") < 64, "small_packets")
                     .when(F.col("packet_length_mean") > 1400, "large_packets"))
    parts += [F.when(F.col(c) > 0, "flag_" + c.split("_")[0]) for c in fv.FLAG_COLUMNS if has(c)]
    return F.concat_ws(" ", *parts)


def text_columns(df: DataFrame) -> list[str]:
    """Up to 25 columns chosen by three keyword tiers, else the first 8 numeric ones."""
    chosen: list[str] = []
    for tier in fv.TEXT_COLUMN_TIERS:
        chosen += [c for c in df.columns if c not in chosen and any(k in c.lower() for k in tier)]
    return chosen[: fv.TEXT_COLUMN_LIMIT] or numeric_columns(df)[: fv.TEXT_COLUMN_FALLBACK]


def numbers_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Integer parts of the chosen columns joined by spaces; NULLs are skipped."""
    numeric = set(numeric_columns(df))
    parts = [F.col(c).cast("bigint").cast("string") if c in numeric else F.col(c).cast("string")
             for c in (columns or text_columns(df))]
    return F.concat_ws(" ", *parts)
