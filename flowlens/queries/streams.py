"""Structured Streaming queries (ST, S20); each reads a table as files over several micro-batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.operators import alerts as al, features as ft, reports as rp
from flowlens.queries import query
from flowlens.queries import sql as S
from flowlens.queries.aggregates import rounded
from flowlens.session import new_path
from flowlens.sources import tables as tb
from flowlens.streaming import flows as sf_, late, state

#: Rows of one file of a feed; a task writes a file, so this bounds what it reads.
FILE_ROWS = 1_000_000


def feed(spark: SparkSession, df: DataFrame, files: int, per_trigger: int, *by: Column) -> DataFrame:
    """The rows of a table as a stream of ``files`` files, ``per_trigger`` a micro-batch.

    A larger table has as many times the files, and a batch as many times more, as it takes to
    keep a file near ``FILE_ROWS``: the number of micro-batches stays, and no task grows with the table.
    """
    times = max(1, math.ceil(df.count() / (files * FILE_ROWS)))
    path = new_path(spark, "feed")
    df.repartition(files * times, *by).write.parquet(path)
    return sf_.source(spark, path, df.schema, files_per_trigger=per_trigger * times)


def replay(spark: SparkSession, df: DataFrame, files: int = 4) -> DataFrame:
    """The rows of a table as a stream of several files, two per micro-batch."""
    return feed(spark, df, files, 2)


def to_table(spark: SparkSession, stream: DataFrame, on_disk: bool = False) -> DataFrame:
    out = new_path(spark, "sink")
    sf_.run_to_table(stream, out, new_path(spark, "checkpoint"), on_disk=on_disk)
    return spark.read.schema(stream.schema).parquet(out)


def to_latest(spark: SparkSession, stream: DataFrame, keys: list[str]) -> DataFrame:
    out = new_path(spark, "upserts")
    sf_.run_upserts(stream, out, new_path(spark, "checkpoint"), keys)
    return sf_.latest_upserts(spark, out, keys)


def alert_stream(spark, sf) -> DataFrame:
    """Enriched alerts; the files of the replay carry no order, so the watermark waits for the table's own span."""
    alerts = tb.alerts(spark, sf)
    return al.enrich(sf_.event_time(replay(spark, alerts), delay=sf_.span(alerts)))


@query("s20_stream_source", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s20(spark, sf):
    rows = to_table(spark, replay(spark, tb.table(spark, sf, "events")))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_ST = "s AS (SELECT avg(flow_duration) AS dm, stddev_samp(flow_duration) AS ds FROM flows)"


@query("st01_stream_scoring", f"""WITH {S.FLOW_ALERTS}, {_ST} SELECT flow_id, round((flow_duration - dm) / ds, 6) AS flow_duration_std, severity, model_used, ensemble FROM alerts, s""")
def st01(spark, sf):
    flows = tb.flows(spark, sf)
    scored = sf_.score_flows(replay(spark, flows), ft.feature_stats(flows))
    return rounded(to_table(spark, scored.select("flow_id", "flow_duration_std", "severity", "model_used", "ensemble")), "flow_duration_std")


@query("st02_first_seen_pairs", f"WITH {S.ALERTS} SELECT DISTINCT src_ip, dst_ip FROM alerts0")
def st02(spark, sf):
    stream = replay(spark, tb.alerts(spark, sf))
    return to_table(spark, sf_.first_seen_pairs(stream).select("src_ip", "dst_ip"), on_disk=True)


@query("st03_severity_windows", f"""WITH {S.ALERTS_ENRICHED}, w AS (SELECT epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) AS last, severity FROM alerts WHERE {S.VALID}),
x AS (SELECT last - 300000000 * unnest([0, 1, 2, 3, 4, 5]) AS start_us, severity FROM w)
SELECT start_us, severity, count(*) AS n FROM x GROUP BY 1, 2""")
def st03(spark, sf):
    out = to_latest(spark, sf_.severity_windows(alert_stream(spark, sf)), ["window_start", "window_end", "severity"])
    return out.select(F.unix_micros("window_start").alias("start_us"), "severity", "n")


@query("st04_frequency_windows", f"""WITH {S.ALERTS_ENRICHED} SELECT epoch_us(date_trunc('hour', ts)) AS start_us, attack_type, severity, count(*) AS n FROM alerts
WHERE {S.VALID} AND attack_type <> 'Benign' GROUP BY 1, 2, 3""")
def st04(spark, sf):
    out = to_latest(spark, sf_.frequency_windows(alert_stream(spark, sf)), ["window_start", "attack_type", "severity"])
    return out.select(F.unix_micros("window_start").alias("start_us"), "attack_type", "severity", "n")


ST03_SQL = f"""WITH {S.ALERTS_ENRICHED}, w AS (SELECT epoch_us(time_bucket(INTERVAL 5 MINUTES, ts)) AS last, severity FROM alerts WHERE {S.VALID}),
x AS (SELECT last - 300000000 * unnest([0, 1, 2, 3, 4, 5]) AS start_us, severity FROM w)
SELECT start_us, severity, count(*) AS n FROM x GROUP BY 1, 2"""


def disordered(spark, sf, files: int = 12) -> DataFrame:
    """Enriched alerts as a feed of ``files`` micro-batches in no order of time: most batches hold late rows."""
    alerts = al.enrich(tb.alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")))
    return feed(spark, alerts, files, 1, F.xxhash64("flow_id"))


@query("st03_windows_and_late_rows", ST03_SQL)
def st03_late(spark, sf):
    """Severity windows of a disordered feed with a short delay: the table plus its late rows are the batch report."""
    keys = ["window_start", "window_end", "severity"]
    store = late.run_windows(disordered(spark, sf), new_path(spark, "windows"), new_path(spark, "checkpoint"), sf_.severity_windows, keys)
    both = store.read("windows")
    side = store.read("late")
    if side is not None:
        both = both.unionByName(sf_.severity_windows(side)).groupBy(*keys).agg(F.sum("n").alias("n"))
    return both.select(F.unix_micros("window_start").alias("start_us"), "severity", "n")


@query("st04_windows_and_late_rows", f"""WITH {S.ALERTS_ENRICHED} SELECT epoch_us(date_trunc('hour', ts)) AS start_us, attack_type, severity, count(*) AS n FROM alerts
WHERE {S.VALID} AND attack_type <> 'Benign' GROUP BY 1, 2, 3""")
def st04_late(spark, sf):
    keys = ["window_start", "attack_type", "severity"]
    store = late.run_windows(disordered(spark, sf), new_path(spark, "windows"), new_path(spark, "checkpoint"), sf_.frequency_windows, keys, delay="1 hour")
    both = store.read("windows")
    side = store.read("late")
    if side is not None:
        both = both.unionByName(sf_.frequency_windows(side)).groupBy(*keys).agg(F.sum("n").alias("n"))
    return both.select(F.unix_micros("window_start").alias("start_us"), "attack_type", "severity", "n")


@query("st05_running_detection_time", f"""WITH {S.ALERTS_ENRICHED} SELECT attack_type, round(sum(detection_time), 6) AS total_time, count(*) AS n, round(avg(detection_time), 6) AS running_mean
FROM alerts WHERE n_agreeing > 0 AND attack_type <> 'Benign' GROUP BY 1""")
def st05(spark, sf):
    return rounded(to_latest(spark, sf_.detection_time_totals(alert_stream(spark, sf), ["attack_type"]), ["attack_type"]), "total_time", "running_mean")


@query("st06_verdict_state", """SELECT flow_id, is_threat, analysis_time FROM (SELECT 'user_' || user_id AS flow_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_threat,
  value AS analysis_time, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND is_threat IS NOT NULL""")
def st06(spark, sf):
    from flowlens.queries.verification import repeated_events

    path = new_path(spark, "verdicts")
    state.run_verdict_log(replay(spark, repeated_events(spark, sf)), path, new_path(spark, "checkpoint"))
    return state.current_verdicts(spark, path).select("flow_id", "is_threat", "analysis_time")


@query("st07_stream_join", f"""WITH {S.VERIFS}, {S.ALERTS_ENRICHED} SELECT a.flow_id, severity, is_threat FROM alerts a JOIN verifs v ON a.flow_id = v.flow_id
AND v.verified_at + INTERVAL 10 MINUTES BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR""")
def st07(spark, sf):
    verdicts = tb.verifications(spark, sf).withColumn("verified_at", F.expr("verified_at + interval 10 minutes"))
    stream = sf_.event_time(replay(spark, verdicts, files=2), "verified_at", sf_.span(verdicts, "verified_at"))
    return to_table(spark, sf_.join_verifications(alert_stream(spark, sf), stream).select("flow_id", "severity", "is_threat"))


@query("st07_interval_join", f"""WITH {S.VERIFS}, {S.ALERTS_ENRICHED} SELECT a.flow_id, severity, is_threat FROM alerts a JOIN verifs v ON a.flow_id = v.flow_id
AND v.verified_at + INTERVAL 10 MINUTES BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR""")
def st07_tables(spark, sf):
    """The same join kept as tables, with a delay that covers the feed's disorder."""
    verdicts = tb.verifications(spark, sf).withColumn("verified_at", F.expr("verified_at + interval 10 minutes").cast("timestamp")).select(
        "flow_id", "verified_at", "is_threat")
    alerts = al.enrich(tb.alerts(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp")).select("flow_id", "ts", "severity")
    store = late.run_interval_join(replay(spark, alerts, files=6), replay(spark, verdicts, files=2), new_path(spark, "join"), new_path(spark, "checkpoint"),
                                   "flow_id", "ts", "verified_at", delay=sf_.span(alerts.unionByName(verdicts.select("flow_id", F.col("verified_at").alias("ts"), F.lit("").alias("severity")))))
    return store.read("joined").select("flow_id", "severity", "is_threat")


@query("st08_sink_status", f"""WITH {S.ALERTS} SELECT count(*) AS n_alerts, round((epoch_us(max(ts)) + 2700000000 - epoch_us(max(ts))) / 60000000, 3) AS age_minutes, true AS is_stale FROM alerts0""")
def st08(spark, sf):
    sink = to_table(spark, alert_stream(spark, sf).select("flow_id", "ts", "severity"))
    newest = sink.agg(F.struct((F.max("ts") + F.expr("interval 45 minutes")).alias("t")).alias("s")).scalar()["t"]
    return rp.report_status(sink, newest).select("n_alerts", F.round("age_minutes", 3).alias("age_minutes"), "is_stale")


@query("st10_stream_progress", "SELECT count(*) AS total, count(*) AS streamed, CAST(0 AS BIGINT) AS remaining FROM events")
def st10(spark, sf):
    events = tb.table(spark, sf, "events")
    p = sf_.progress(to_table(spark, replay(spark, events)), events.count())
    return spark.createDataFrame([(p["total"], p["streamed"], p["remaining"])], "total long, streamed long, remaining long")


@query("st11_reset_stream", "SELECT 'first' AS run, count(*) AS n FROM events UNION ALL SELECT 'after reset', count(*) FROM events")
def st11(spark, sf):
    """A reset starts from a new checkpoint and a new sink: every row is seen again, once."""
    stream = feed(spark, tb.table(spark, sf, "events"), 2, 100)
    runs = []
    for name in ("first", "after reset"):
        rows = to_table(spark, stream)
        runs.append(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("run"), "n"))
    return runs[0].unionByName(runs[1])
