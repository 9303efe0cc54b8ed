"""Streams whose late rows are kept: windows and interval joins as tables, with a side table for what comes too late.

The watermark of a batch is the newest event time of all batches before it, less the delay.  Rows
behind it go to the side table ``late`` instead of being dropped; they are counted there, can
be looked at and be added later.  Results and watermark are committed together with each batch, so
nothing is lost or counted twice when a batch is retried, and no state is held in memory between batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.streaming.store import Store, summed


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything available through ``write``, then stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def seconds(spark: SparkSession, delay: str) -> int:
    """An interval like '10 minutes' in whole seconds."""
    return int(spark.range(1).select(F.expr(f"unix_seconds(timestamp'2000-01-01 00:00:00' + interval {delay}) - unix_seconds(timestamp'2000-01-01 00:00:00')")).first()[0])


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def split(batch: DataFrame, column: str, mark: int | None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, rows behind the watermark); rows without an event time are in time."""
    if mark is None:
        return batch, batch.limit(0)
    late = F.coalesce(_micros(column) < mark, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def advance(batch: DataFrame, column: str, mark: int | None, delay: int) -> int | None:
    """The watermark after a batch."""
    newest = batch.agg(F.max(_micros(column))).first()[0]
    found = [m for m in (mark, None if newest is None else newest - delay * 1_000_000) if m is not None]
    return max(found, default=None)


def window_store(spark: SparkSession, path: str, keys: list[str]) -> Store:
    return Store(spark, path, {"windows": summed(keys), "late": None})


def run_windows(stream: DataFrame, path: str, checkpoint: str, aggregate: Callable[[DataFrame], DataFrame], keys: list[str],
                column: str = "ts", delay: str = "10 minutes") -> Store:
    """Windowed sums of a stream, kept as a compacted table, and its late rows.

    ``aggregate`` is the batch report: it groups by ``keys`` and its other columns add up over batches.
    """
    spark = stream.sparkSession
    store, wait = window_store(spark, path, keys), seconds(spark, delay)

    def write(batch: DataFrame, batch_id: int) -> None:
        now = store.manifest()
        if batch_id <= now.upto:
            return
        batch = batch.persist()
        try:
            mark = now.facts.get("watermark")
            fresh, late = split(batch, column, mark)
            tables = {"windows": aggregate(fresh)}
            n = late.count()
            if n:
                tables["late"] = late
            store.append(batch_id, tables, {"watermark": advance(batch, column, mark, wait), "late_rows": now.facts.get("late_rows", 0) + n})
        finally:
            batch.unpersist()

    run_batches(stream, write, checkpoint)
    return store


def run_interval_join(left: DataFrame, right: DataFrame, path: str, checkpoint: str, key: str, left_at: str, right_at: str,
                      within: str = "1 hour", delay: str = "10 minutes") -> Store:
    """Rows of ``right`` that follow a row of ``left`` with the same key within a time; an inner join of two streams.

    Both sides come through one stream, so a batch holds new rows of either.  New rows meet
    the new and the stored rows of the other side.  Stored rows that no row in time can still meet are left
    out when their run is merged.  Results are table ``joined``, rows behind the watermark ``late_left`` and ``late_right``.
    """
    spark = left.sparkSession
    reach, wait = seconds(spark, within), seconds(spark, delay)
    a = left.select(F.lit(0).alias("side"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema).alias("r"))
    b = right.select(F.lit(1).alias("side"), F.lit(None).cast(left.schema).alias("l"), F.struct(*right.columns).alias("r"))
    store = Store(spark, path, {})

    def live(column: str, slack: int):
        def merge(df: DataFrame) -> DataFrame:
            mark = store.manifest().facts.get("watermark")
            return df if mark is None else df.filter(F.coalesce(_micros(column) + slack * 1_000_000 >= mark, F.lit(False)))
        return merge

    # a left row waits for verdicts up to ``within`` after it, a right row only for left rows that are late by the delay
    store.merges = {"left": live(left_at, reach), "right": live(right_at, 0), "joined": None, "late_left": None, "late_right": None}

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(*[F.col(c).alias(f"__r_{c}") for c in right.columns])
        gap = _micros(f"__r_{right_at}") - _micros(left_at)
        found = x.join(y, (F.col(key) == F.col(f"__r_{key}")) & gap.between(0, reach * 1_000_000))
        own = [c for c in right.columns if c not in left.columns]
        return found.select(*left.columns, *[F.col(f"__r_{c}").alias(c) for c in own])

    def write(batch: DataFrame, batch_id: int) -> None:
        now = store.manifest()
        if batch_id <= now.upto:
            return
        batch = batch.persist()
        try:
            mark = now.facts.get("watermark")
            new_l, late_l = split(batch.filter("side = 0").select("l.*"), left_at, mark)
            new_r, late_r = split(batch.filter("side = 1").select("r.*"), right_at, mark)
            old_l, old_r = store.read("left"), store.read("right")
            joined = meet(new_l, new_r if old_r is None else new_r.unionByName(old_r))
            if old_l is not None:
                joined = joined.unionByName(meet(old_l, new_r))
            # the two streams move on together: the slower one sets the watermark
            ends = [advance(batch.filter("side = 0").select("l.*"), left_at, now.facts.get("left"), wait),
                    advance(batch.filter("side = 1").select("r.*"), right_at, now.facts.get("right"), wait)]
            tables = {"left": new_l, "right": new_r, "joined": joined}
            counts = {"late_left": late_l.count(), "late_right": late_r.count()}
            tables |= {name: df for name, df in (("late_left", late_l), ("late_right", late_r)) if counts[name]}
            facts = {"left": ends[0], "right": ends[1], "watermark": None if None in ends else min(ends)}
            facts |= {name: now.facts.get(name, 0) + n for name, n in counts.items()}
            store.append(batch_id, tables, facts)
        finally:
            batch.unpersist()

    run_batches(a.unionByName(b), write, checkpoint)
    return store
