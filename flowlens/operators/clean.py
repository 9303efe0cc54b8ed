"""Cleaning: missing values, duplicates, type coercion, data-quality profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens import fixed_values as fv
from flowlens.functions import numeric as nm
from flowlens.sources.schema import numeric_columns, string_columns

_FLOAT = (T.DoubleType, T.FloatType)


def _float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _FLOAT)]


def nullify_non_finite(df: DataFrame) -> DataFrame:
    """NaN and ±Inf become NULL in every floating column, one projection."""
    cols = _float_columns(df)
    return df.withColumns({c: nm.finite_or_null(F.col(c)) for c in cols}) if cols else df


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def clean(df: DataFrame) -> DataFrame:
    """Non-finite to NULL, empty rows out, full duplicates out."""
    return drop_empty_rows(nullify_non_finite(df)).dropDuplicates()


def split_metadata(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata, features); both keep ``flow_id`` so they can be joined by key."""
    meta = [c for c in fv.METADATA_COLUMNS if c in df.columns]
    rest = [c for c in df.columns if c not in meta or c == "flow_id"]
    return df.select(*meta), df.select(*rest)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to double; unparsable text becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def final_cleanup(df: DataFrame, keep: tuple[str, ...] = (), coerce: tuple[str, ...] = ()) -> DataFrame:
    """Coerce, drop leftover string columns, fill NULL with 0."""
    df = coerce_numeric(df, list(coerce)) if coerce else df
    drop = [c for c in string_columns(df, exclude=keep)]
    df = nullify_non_finite(df.drop(*drop))
    return df.na.fill(0, subset=numeric_columns(df, exclude=keep))


def variances(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, variance)`` from one pass."""
    one = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "variance")


def low_variance_features(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """``(feature, variance, kept)``; kept where the variance exceeds the threshold."""
    return variances(df, columns).withColumn("kept", F.col("variance") > threshold)


def pad_columns(df: DataFrame, names: list[str] = fv.PACKET_SUMMARY_COLUMNS,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the named columns as doubles; absent ones are 0."""
    cols = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in names]
    return df.select(*keep, *cols)


def _is_infinite(c: Column) -> Column:
    return F.abs(c) == F.lit(float("inf"))


def quality_profile(df: DataFrame, label: str | None = None) -> DataFrame:
    """``(section, item, value)``: shape, types, nulls, infinities, classes.

    One aggregate pass over all columns, plus one grouped count for labels.
    """
    cols = [c for c in df.columns if c != label]
    floats = [c for c in _float_columns(df) if c in cols]
    numeric, strings = numeric_columns(df, (label,)), string_columns(df, (label,))

    def missing(c: str) -> Column:
        test = F.col(c).isNull() | (F.isnan(c) if c in floats else F.lit(False))
        return F.count_if(test)

    one = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[missing(c).alias(f"null:{c}") for c in cols],
        *[F.count_if(_is_infinite(F.col(c))).alias(f"inf:{c}") for c in floats],
    )
    type_counts: dict[str, int] = {}
    for f in df.schema.fields:
        if f.name in cols:
            type_counts[f.dataType.simpleString()] = type_counts.get(f.dataType.simpleString(), 0) + 1
    inf_total = sum([F.col(f"`inf:{c}`") for c in floats], F.lit(0).cast("bigint"))

    def entry(section: str, item: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(item).alias("item"),
                        value.cast("double").alias("value"))

    entries = [
        entry("shape", "rows", F.col("rows")), entry("shape", "columns", F.lit(len(cols))),
        entry("features", "numeric", F.lit(len(numeric))),
        entry("features", "categorical", F.lit(len(strings))),
        entry("infinite", "total", inf_total),
        *[entry("dtype", t, F.lit(n)) for t, n in type_counts.items()],
        *[entry("missing", c, F.col(f"`null:{c}`")) for c in cols],
    ]
    profile = one.select(F.inline(F.array(*entries))).filter(
        (F.col("section") != "missing") | (F.col("value") > 0))
    if label is None:
        return profile
    counts = df.groupBy(F.col(label).cast("string").alias("item")).agg(
        F.count(F.lit(1)).cast("double").alias("value"))
    classes = counts.select(F.lit("class").alias("section"), "item", "value")
    ratio = F.try_divide(F.max("value"), F.min("value"))
    balance = counts.agg(ratio.alias("r")).select(F.inline(F.array(
        entry("imbalance", "ratio", F.col("r")),
        entry("imbalance", "severe", (F.col("r") > 10).cast("int")),
    )))
    return profile.unionByName(classes).unionByName(balance)
