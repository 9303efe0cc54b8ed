"""Canonical flow schema and tolerant column resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens import fixed_values as fv

# Flow columns of the canonical schema: name -> Spark type.
FLOW_SCHEMA = T.StructType(
    [T.StructField("flow_id", T.StringType()), T.StructField("src_ip", T.StringType()),
     T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
     T.StructField("dst_port", T.IntegerType()), T.StructField("ts", T.TimestampNTZType()),
     T.StructField("protocol", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "flow_duration", "packet_length_mean", "flow_bytes_per_s", "flow_packets_per_s")]
    + [T.StructField(c, T.IntegerType()) for c in ("total_fwd_packets", "total_bwd_packets")]
    + [T.StructField(c, T.IntegerType()) for c in fv.FLAG_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in fv.IAT_COLUMNS]
)

NUMERIC_TYPES = (T.NumericType,)
# Columns of whole numbers among the features of an export; the others are doubles.
_WHOLE = ("_flags", "_flag_count", "_packets", "_pkts", "protocol", "_bytes")


def canonical_name(name: str) -> str:
    """``Flow Bytes/s`` -> ``flow_bytes_per_s``; ``Src IP`` -> ``src_ip``."""
    s = name.strip().lower().replace("/s", "_per_s").replace("/", "_")
    return re.sub(r"[^0-9a-z]+", "_", s).strip("_")


def feature_column(header: str) -> str:
    """The library's name of an export header."""
    name = canonical_name(header)
    return fv.COLUMN_ALIASES.get(name, name)


def export_schema() -> T.StructType:
    """All columns of a flow export under the library's names: ids, time, the features, the label."""
    known = {f.name: f for f in FLOW_SCHEMA.fields}
    fields = [known[c] for c in ("flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "ts")]
    for header in fv.EXPORT_FEATURES:
        name = feature_column(header)
        whole = name.endswith(_WHOLE)
        fields.append(known.get(name, T.StructField(name, T.LongType() if whole else T.DoubleType())))
    return T.StructType([*fields, T.StructField("label", T.StringType())])


def typed(df: DataFrame) -> DataFrame:
    """A raw export read as text, under the library's names and the types of the export schema.

    Text that is no number becomes NULL; whole numbers may be written with a fraction of
    zero; columns beyond the schema stay as they are.
    """
    kinds = {f.name: f.dataType for f in export_schema().fields}

    def cast(c: str) -> Column:
        kind = kinds.get(c)
        if kind is None or isinstance(kind, (T.StringType, T.TimestampNTZType)):
            return F.col(c)
        number = F.trim(F.col(c).cast("string")).try_cast("double")
        if isinstance(kind, T.DoubleType):
            return number.alias(c)
        return F.when(number == F.floor(number), number.try_cast(kind)).alias(c)

    named = resolve_columns(df)
    return named.select(*[cast(c) for c in named.columns])


def resolve_columns(df: DataFrame) -> DataFrame:
    """A raw export under the names the library uses: canonical form, then known aliases.

    The first column of an alias group keeps the name; headers that become equal are
    numbered on.  ``ts`` is parsed from text by the export's own formats.
    """
    taken: dict[str, int] = {}
    out = []
    for c in df.columns:
        name = canonical_name(c)
        if not any(canonical_name(o) == fv.COLUMN_ALIASES.get(name) for o in df.columns):
            name = fv.COLUMN_ALIASES.get(name, name)
        taken[name] = taken.get(name, 0) + 1
        out.append(F.col(f"`{c}`").alias(name if taken[name] == 1 else f"{name}_{taken[name]}"))
    renamed = df.select(*out)
    if dict(renamed.dtypes).get("ts") == "string":
        parsed = [F.try_to_timestamp("ts", F.lit(f)) for f in fv.TIMESTAMP_FORMATS]
        renamed = renamed.withColumn("ts", F.coalesce(*parsed).cast("timestamp_ntz"))
    return renamed


def find_label_column(columns: list[str]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[n] for n in fv.LABEL_COLUMN_NAMES if n in by_lower), None)


def with_label(df: DataFrame, name: str = "label") -> DataFrame:
    found = find_label_column(df.columns)
    if found is None:
        raise ValueError("no label column among " + ", ".join(df.columns))
    return df if found == name else df.withColumnRenamed(found, name)


def first_non_blank(df: DataFrame, aliases: list[str], default: str = "N/A") -> Column:
    """First alias column whose trimmed text is not empty, per row."""
    by_name = {canonical_name(c): c for c in df.columns}
    present = [by_name[a] for a in aliases if a in by_name]
    parts = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in present]
    return F.coalesce(*parts, F.lit(default))


def with_ips(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "src_ip": first_non_blank(df, fv.SRC_IP_ALIASES),
        "dst_ip": first_non_blank(df, fv.DST_IP_ALIASES),
    })


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]
