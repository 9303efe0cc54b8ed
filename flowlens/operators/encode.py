"""Label and categorical encoding.

Codes are ranks over the *distinct* values, found by one shuffle of distincts;
the flow table itself is never sorted or put in one window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowlens import fixed_values as fv
from flowlens.functions.lookup import literal_table
from flowlens.session import materialize

NA = "___NA___"
# Dictionaries up to this many entries are broadcast; larger ones are joined by shuffle.
BROADCAST_ENTRIES, BROADCAST_BYTES = 100_000, 16 << 20


def label_dictionary(spark: SparkSession, classes: list[str] = fv.CLASSES) -> DataFrame:
    """``(label_idx, label)`` in alphabetical order; one row per class."""
    return literal_table(spark, ["label_idx", "label"], list(enumerate(sorted(classes))))


def with_label_name(df: DataFrame, idx: str, out: str, classes: list[str] = fv.CLASSES) -> DataFrame:
    """Class name of an index by left join; ``Attack_<i>`` or ``Unknown`` otherwise."""
    names = label_dictionary(df.sparkSession, classes).select(
        F.col("label_idx").alias("__idx"), F.col("label").alias("__name"))
    fallback = F.when(F.col(idx).isNull(), "Unknown").otherwise(F.concat(F.lit("Attack_"), F.col(idx).cast("string")))
    return (
        df.join(F.broadcast(names), F.col(idx) == F.col("__idx"), "left")  # one row per class
        .withColumn(out, F.coalesce("__name", fallback))
        .drop("__idx", "__name")
    )


def distinct_values(df: DataFrame, column: str, null_value: str | None = None) -> DataFrame:
    value = F.col(column) if null_value is None else F.coalesce(F.col(column).cast("string"), F.lit(null_value))
    return df.select(value.alias("value")).filter(F.col("value").isNotNull()).distinct()


def is_small(distinct: DataFrame, max_values: int = BROADCAST_ENTRIES) -> bool:
    """Check of rows and bytes that stops counting just beyond the bound."""
    row = distinct.limit(max_values + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(distinct.columns[0]).cast("string"))).alias("b")).first()
    return row["n"] <= max_values and (row["b"] or 0) <= BROADCAST_BYTES


def dense_codes(distinct: DataFrame, column: str = "value", out: str = "code", small: bool = False) -> DataFrame:
    """Number the rows of an already distinct column in sort order, from 0.

    ``small`` means the caller has checked the size: one window over at most
    ``BROADCAST_ENTRIES`` rows.  Otherwise the values are range-partitioned into
    a written table, and the code is (rows in earlier ranges) + (rank inside the
    range), so any number of values is numbered in parallel; only the row counts
    per range are accumulated globally.
    """
    if small:
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column))
        return distinct.select(column, (rank - 1).cast("bigint").alias(out))
    ranged = materialize(distinct.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "dict")
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column))
    return (
        ranged.withColumn("__rank", rank)
        .join(F.broadcast(offsets), "__part")  # one row per shuffle partition
        .select(column, (F.col("__offset") + F.col("__rank") - 1).cast("bigint").alias(out))
    )


def value_dictionary(df: DataFrame, column: str, null_value: str | None = None) -> DataFrame:
    """``(value, code)``: dense codes of the sorted distinct values."""
    distinct = distinct_values(df, column, null_value)
    return dense_codes(distinct, small=is_small(distinct))


def encode_column(df: DataFrame, column: str, out: str, null_code: int | None = -1,
                  null_value: str | None = None, max_values: int = BROADCAST_ENTRIES) -> DataFrame:
    """Add the dense code of a column; NULL maps to ``null_code`` or to its own value.

    A dictionary within ``max_values`` is broadcast; a larger one is joined by
    shuffle, where AQE splits hot values.
    """
    distinct = distinct_values(df, column, null_value)
    small = is_small(distinct, max_values)
    right = dense_codes(distinct, small=small).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
    key = F.col(column) if null_value is None else F.coalesce(F.col(column).cast("string"), F.lit(null_value))
    joined = df.withColumn("__k", key).join(
        F.broadcast(right) if small else right, F.col("__k") == F.col("__v"), "left")
    code = F.col("__c") if null_code is None else F.coalesce("__c", F.lit(null_code))
    return joined.withColumn(out, code.cast("bigint")).drop("__k", "__v", "__c")


@dataclass(frozen=True)
class Coding:
    """A column to encode: NULL maps to ``null_code``, or counts as ``null_value``."""

    column: str
    out: str
    null_code: int | None = -1
    null_value: str | None = None


def _entry(df: DataFrame, i: int, coding: Coding) -> tuple[Column, Column]:
    """(column number and value as text, place in the order): numbers are ordered as numbers."""
    kind = dict(df.dtypes)[coding.column]
    c = F.col(f"`{coding.column}`")
    number = F.lit(None).cast("bigint")
    if coding.null_value is None and kind in ("tinyint", "smallint", "int", "bigint"):
        number = c.cast("bigint")
    text = c.cast("string") if coding.null_value is None else F.coalesce(c.cast("string"), F.lit(coding.null_value))
    return F.when(text.isNotNull(), F.concat(F.lit(f"{i}:"), text)), number


def distinct_entries(df: DataFrame, codings: list[Coding]) -> DataFrame:
    """(i, number, entry): the distinct values of all columns from one pass, written once."""
    pairs = [F.struct(F.lit(i).alias("i"), number.alias("number"), entry.alias("entry"))
             for i, (entry, number) in enumerate(_entry(df, i, c) for i, c in enumerate(codings))]
    every = df.select(F.inline(F.array(*pairs))).filter(F.col("entry").isNotNull()).distinct()
    return materialize(every, "dictionaries")


def _numbered(entries: DataFrame, small: bool) -> DataFrame:
    """(__e, __c): entries with their place among those of their column, from 0; ``small`` as in ``dense_codes``."""
    order = ["number", "entry"]
    if small:
        code = F.row_number().over(Window.partitionBy("i").orderBy(*order)) - 1
        return entries.select(F.col("entry").alias("__e"), code.cast("bigint").alias("__c"))
    ranged = materialize(entries.repartitionByRange("i", *order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("i", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("i").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select("i", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    rank = F.row_number().over(Window.partitionBy("i", "__part").orderBy(*order))
    return ranged.withColumn("__rank", rank).join(F.broadcast(offsets), ["i", "__part"]).select(
        F.col("entry").alias("__e"), (F.col("__offset") + F.col("__rank") - 1).cast("bigint").alias("__c"), "i")


def encode_columns(df: DataFrame, codings: list[Coding], max_values: int = BROADCAST_ENTRIES) -> DataFrame:
    """Dense codes of several columns.

    Columns whose dictionaries fit share one broadcast table, looked up once per column in one
    stage; larger dictionaries are numbered by ranges and joined by shuffle, where AQE splits hot values.
    """
    if not codings:
        return df
    found = distinct_entries(df, codings)
    sizes = {r["i"]: r for r in found.groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("entry")).alias("b")).collect()}  # one row per column
    small, n, held = [], 0, 0
    for i, r in sorted(sizes.items(), key=lambda x: x[1]["n"]):
        if n + r["n"] <= max_values and held + r["b"] <= BROADCAST_BYTES:
            small.append(i)
            n, held = n + r["n"], held + r["b"]
    shared = F.broadcast(_numbered(found.filter(F.col("i").isin(small)), small=True))
    large = None if len(small) == len(sizes) else materialize(_numbered(found.filter(~F.col("i").isin(small)), small=False), "codes")
    for i, coding in enumerate(codings):
        right = large.filter(F.col("i") == i).drop("i") if i in sizes and i not in small else shared
        joined = df.withColumn("__k", _entry(df, i, coding)[0]).join(right, F.col("__k") == F.col("__e"), "left")
        code = F.col("__c") if coding.null_code is None else F.coalesce("__c", F.lit(coding.null_code))
        df = joined.withColumn(coding.out, code.cast("bigint")).drop("__k", "__e", "__c")
    return df


def label_coding(column: str = "label", out: str = "label_idx") -> Coding:
    """Alphabetical label index; a missing label is the class ``UNKNOWN``."""
    return Coding(column, out, None, "UNKNOWN")


def encode_labels(df: DataFrame, column: str = "label", out: str = "label_idx") -> DataFrame:
    """Alphabetical label index; a missing label is the class ``UNKNOWN``."""
    return encode_column(df, column, out, null_code=None, null_value="UNKNOWN")


@dataclass(frozen=True)
class CategoricalPlan:
    """Which string columns are encoded and which are dropped."""

    encode: tuple[str, ...]
    drop: tuple[str, ...]


def profile_categoricals(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, max_length, distinct_values)`` from one pass of lengths and sketches."""
    aggs = []
    for c in columns:
        aggs += [F.max(F.length(c)).cast("bigint").alias(f"{c}__len"),
                 F.approx_count_distinct(F.coalesce(F.col(c), F.lit(NA)), 0.02).alias(f"{c}__n")]
    items = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__len").alias("max_length"),
                      F.col(f"{c}__n").alias("distinct_values")) for c in columns]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def plan_categoricals(df: DataFrame, columns: list[str], max_distinct: int = 100,
                      hash_length: int = 20) -> CategoricalPlan:
    """Hash-like (long) or low-cardinality columns are encoded, others dropped.

    Only where the sketch is near the limit are the distinct values counted,
    and that count stops just beyond the limit.
    """
    keep, drop = [], []
    for r in profile_categoricals(df, columns).collect():  # one row per string column
        n = r["distinct_values"]
        low = n <= max_distinct
        if 0.8 * max_distinct < n < 1.25 * max_distinct:
            low = is_small(distinct_values(df, r["column"], NA), max_distinct)
        good = (r["max_length"] or 0) > hash_length or low
        (keep if good else drop).append(r["column"])
    return CategoricalPlan(tuple(keep), tuple(drop))


def categorical_codings(plan: CategoricalPlan) -> list[Coding]:
    return [Coding(c, f"{c}_encoded", None, NA) for c in plan.encode]


def encode_categoricals(df: DataFrame, plan: CategoricalPlan) -> DataFrame:
    return encode_columns(df, categorical_codings(plan)).drop(*plan.encode, *plan.drop)
