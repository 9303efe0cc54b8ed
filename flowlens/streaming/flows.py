"""Streaming sources, scoring, dedupe and windowed reports.

Every transform is the batch operator itself; statistics come from a fitted
dict, because a stream has no global aggregate.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Any, Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators import alerts as al, features as ft, fuzzy as fz, reports as rp
from flowlens.streaming.store import Store, newest


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as a stream; new files are new data."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def event_time(df: DataFrame, column: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Timestamp column with a watermark; later rows are dropped from state."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def score_flows(df: DataFrame, stats: dict[str, Any],
                model: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Features from fitted statistics, fuzzy score, optional model, alert columns."""
    featured = fz.with_fuzzy_features(ft.engineer(df, stats))
    scored = model(featured) if model else featured
    return al.enrich(scored)


def first_seen_pairs(df: DataFrame) -> DataFrame:
    """First row of every (source, destination) pair, however late the pair returns.

    Exact, so every distinct pair stays in the state store; ``run_to_table`` with
    ``on_disk`` keeps it in RocksDB files, whose memory is bounded.
    """
    return df.dropDuplicates(["src_ip", "dst_ip"])


def span(df: DataFrame, column: str = "ts") -> str:
    """A watermark delay that covers all of a stored table: its whole span of time, plus a minute."""
    row = df.agg(F.unix_seconds(F.min(F.col(column).cast("timestamp"))).alias("a"),
                 F.unix_seconds(F.max(F.col(column).cast("timestamp"))).alias("b")).first()
    return f"{(row['b'] or 0) - (row['a'] or 0) + 60} seconds"


def severity_windows(df: DataFrame, length: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    return rp.windowed_severity(df, length, slide)


def frequency_windows(df: DataFrame, length: str = "1 hour") -> DataFrame:
    return rp.windowed_frequency(df, length)


def detection_time_totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Running mean of detection time per key as sum and count, for update mode."""
    counted = df.filter((F.col("n_agreeing") > 0) & ~al.is_benign())
    return counted.groupBy(*by).agg(
        F.sum("detection_time").alias("total_time"), F.count("detection_time").alias("n"),
        F.avg("detection_time").alias("running_mean"))


def join_verifications(alerts: DataFrame, verdicts: DataFrame, within: str = "1 hour") -> DataFrame:
    """Alert with its verdict when the verdict comes within a time bound.

    Both sides need a watermark; the bound lets Spark drop old state.
    """
    a = alerts.select(*[F.col(c) for c in alerts.columns])
    v = verdicts.select(F.col("flow_id").alias("v_flow_id"), "verified_at", "is_threat", "analysis_time")
    bound = F.expr(f"v_flow_id = flow_id AND verified_at >= ts AND verified_at <= ts + INTERVAL {within}")
    return a.join(v, bound, "inner").drop("v_flow_id")


# State on local disk with a bound on its memory, checkpointed as changes.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for what starts inside the block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append", on_disk: bool = False) -> StreamingQuery:
    """Process everything available into a parquet table, then stop; ``on_disk`` keeps state in RocksDB."""
    with settings(df.sparkSession, ON_DISK if on_disk else {}):
        query = (
            df.writeStream.outputMode(mode).format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query


def upserts(spark: SparkSession, path: str, keys: list[str]) -> Store:
    """The compacted table of changed groups, newest batch first."""
    return Store(spark, path, {"rows": newest(keys, ["batch_id"])})


def run_upserts(df: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "update") -> StreamingQuery:
    """Changed groups of each batch into a compacted table; a batch that is retried counts once."""
    store = upserts(df.sparkSession, path, keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch_id, {"rows": batch.withColumn("batch_id", F.lit(batch_id).cast("long"))})

    query = (
        df.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest_upserts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key."""
    return upserts(spark, path, keys).read("rows").drop("batch_id")


def progress(sink: DataFrame, total: int) -> dict[str, int]:
    """Rows streamed so far and rows remaining of a known total.

    Counts what the sink holds (file sinks commit each batch once), since Spark keeps
    the progress of its last hundred batches only.
    """
    streamed = sink.count()
    return {"total": total, "streamed": streamed, "remaining": max(total - streamed, 0)}
