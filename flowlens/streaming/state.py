"""Keyed verdict state without streaming state: a compacted log of verdicts, latest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.operators.verify import latest
from flowlens.streaming.store import Store


def verdicts(spark: SparkSession, path: str, key: str = "flow_id", at: str = "verified_at") -> Store:
    """The compacted log: one row per key and run, the newest by time and sequence."""
    return Store(spark, path, {"events": lambda df: latest(df, key, at)})


def run_verdict_log(events: DataFrame, path: str, checkpoint: str, key: str = "flow_id",
                    at: str = "verified_at") -> StreamingQuery:
    """Keep the newest event per key of every micro-batch in a compacted table.

    No streaming state: a flow with very many events costs one row per run, and runs are
    merged as they gather.  A batch that is retried counts once.
    """
    store = verdicts(events.sparkSession, path, key, at)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch_id, {"events": batch})

    query = (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def current_verdicts(spark: SparkSession, path: str, key: str = "flow_id", at: str = "verified_at") -> DataFrame:
    """Newest verdict of every key, whatever order the events came in.

    Events of equal time go by their sequence number; a newest event without a verdict
    withdraws the flow.
    """
    return verdicts(spark, path, key, at).read("events").filter(F.col("is_threat").isNotNull())
