"""Table, report and log sinks.  Every sink is a distributed Spark write."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F

#: Rows of one file of the detection log: some 200 MB of text, which one task unpacks.
LOG_FILE_ROWS = 1_000_000


def write_processed(df: DataFrame, path: str) -> None:
    """Train/test table partitioned by ``split``; readers prune on it."""
    df.write.partitionBy("split").parquet(path)


def read_processed(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def preprocessing_info(df: DataFrame, features: list[str], classes: list[str],
                       weights: DataFrame, scaler: str) -> DataFrame:
    """One row describing a preprocessing run; ``weights`` has one row per class."""
    return weights.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label_idx").cast("string"), "weight")))).alias("class_weights")
    ).select(
        F.lit(len(features)).alias("feature_count"),
        F.array(*[F.lit(c) for c in features]).alias("feature_names"),
        F.array(*[F.lit(c) for c in classes]).alias("label_classes"),
        F.lit(scaler).alias("scaler_type"),
        "class_weights",
    )


def write_csv(df: DataFrame, path: str, compression: str = "none", rows_per_file: int = 0) -> None:
    """Header CSV; a compressed file is read by one task, so large tables also want ``rows_per_file``."""
    _compressed(df.write.option("header", True), compression, rows_per_file).csv(path)


def write_json(df: DataFrame, path: str, append: bool = False, compression: str = "none", rows_per_file: int = 0) -> None:
    _compressed(df.write.mode("append" if append else "errorifexists"), compression, rows_per_file).json(path)


def _compressed(writer: DataFrameWriter, compression: str, rows_per_file: int) -> DataFrameWriter:
    """The fastest level: the default one takes longer than all the rest of a text write."""
    writer = writer.option("compression", compression).option("zlib.compress.level", "BEST_SPEED")
    return writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer


def detection_log(scored: DataFrame, model: str, prediction: str, confidence: str,
                  feature_cols: list[str], matches_col: str | None = None) -> DataFrame:
    """Scored flows in the shape of the detection log."""
    features = F.create_map(*[x for c in feature_cols for x in (F.lit(c), F.col(c).cast("double"))])
    matches = F.col(matches_col) if matches_col else F.array().cast("array<string>")
    return scored.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(model).alias("model_name"),
        "flow_id",
        F.col(prediction).cast("int").alias("prediction"),
        F.col(confidence).cast("double").alias("confidence"),
        features.alias("features"),
        matches.alias("aca_matches"),
        F.lit("pending").alias("verification_status"),
        F.lit(None).cast("int").alias("manual_label"),
        F.lit("").alias("verification_notes"),
    )


def append_detections(log: DataFrame, path: str) -> None:
    write_json(log, path, append=True, compression="gzip", rows_per_file=LOG_FILE_ROWS)
