"""File scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from flowlens.sources.schema import typed

DETECTION_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("prediction", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("aca_matches", T.ArrayType(T.StringType())),
    T.StructField("verification_status", T.StringType()),
    T.StructField("manual_label", T.IntegerType()),
    T.StructField("verification_notes", T.StringType()),
])
CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV; pass a schema in production, types are inferred without one."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A flow export with its own headers, typed by name: no inference pass, no order of columns assumed."""
    return typed(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; a line that is not valid JSON lands in ``_corrupt_record``."""
    with_bad = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.text(path).select(F.from_json("value", with_bad, options).alias("r")).select("r.*")


def read_detection_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed detection events only."""
    log = read_json_lines(spark, path, DETECTION_SCHEMA)
    return log.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """``(pattern, category)``: one pattern per line, blank and ``#`` lines skipped.

    The comment line above a group names its category.  Each file is read as
    one record (``wholetext``), so the line order inside it is kept; the running
    category is a window over the lines of one signature file.
    """
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"),
                F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw"))
        .withColumn("line", F.trim("raw"))
    )
    in_file = Window.partitionBy("file").orderBy("line_no")
    comment = F.when(F.col("line").startswith("#"), F.trim(F.ltrim(F.col("line"), F.lit("#"))))
    return (
        lines.withColumn("category", F.last(comment, ignorenulls=True).over(in_file))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select(F.col("line").alias("pattern"), "category")
    )
