"""Risk, frequency and status reports over alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import safe_div
from flowlens.functions.stats import over_all
from flowlens.session import materialize
from flowlens.operators.alerts import is_benign, is_valid_alert, model_tokens, recent
from flowlens.operators.severity import report_action_table

SEVERITIES = ["High", "Medium", "Low"]


def severity_attack_counts(alerts: DataFrame) -> DataFrame:
    """Valid alerts per (severity, attack): the aggregate behind both reports."""
    return alerts.filter(is_valid_alert()).groupBy("severity", "attack_type").agg(F.count(F.lit(1)).alias("n"))


def top_attacks(counts: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent attacks of each severity, ties by name."""
    w = Window.partitionBy("severity").orderBy(F.desc("n"), "attack_type")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def risk_report(alerts: DataFrame, ref_ts: Column | None = None, minutes: int = 30) -> DataFrame:
    """Count, share and top-3 attacks per severity, with the recommended action.

    All three severities are present, zero-filled.  ``ref_ts`` limits the report
    to the last ``minutes``.
    """
    inside = alerts if ref_ts is None else alerts.filter(recent(F.col("ts"), ref_ts, minutes))
    counts = severity_attack_counts(inside).filter(F.col("severity").isin(SEVERITIES))
    entry = F.struct("rank", "attack_type", "n")
    tops = top_attacks(counts).groupBy("severity").agg(F.array_sort(F.collect_list(entry)).alias("top"))
    sums = counts.groupBy("severity").agg(F.sum("n").alias("n"))
    text = F.transform("top", lambda e: F.concat(e["attack_type"], F.lit(" ("), e["n"].cast("string"), F.lit(")")))
    dim = report_action_table(alerts.sparkSession)
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return dim.join(sums, "severity", "left").join(tops, "severity", "left").select(
        "severity", n.alias("n"), safe_div(n * 100.0, over_all(F.sum(n))).alias("percentage"),
        F.coalesce(F.array_join(text, "; "), F.lit("")).alias("top_attacks"), "action", "description", "timeframe")


def threat_rate(alerts: DataFrame, ref_ts: Column | None = None, minutes: int = 30) -> DataFrame:
    inside = alerts if ref_ts is None else alerts.filter(recent(F.col("ts"), ref_ts, minutes))
    v, n = F.count_if(is_valid_alert()), F.count(F.lit(1))
    return inside.agg(v.alias("total_threats"), n.alias("total_flows"), safe_div(v * 100.0, n).alias("threat_rate"))


def attack_frequency(alerts: DataFrame) -> DataFrame:
    """Count, share and severity breakdown per attack type, benign left out."""
    sev = lambda s: F.count_if(F.col("severity") == s)
    counts = alerts.filter(is_valid_alert() & ~is_benign()).groupBy("attack_type").agg(
        F.count(F.lit(1)).alias("n"), sev("High").alias("high"), sev("Medium").alias("medium"), sev("Low").alias("low"))
    return counts.withColumn("percentage", safe_div(F.col("n") * 100.0, over_all(F.sum("n")))).orderBy(F.desc("n"), "attack_type")


def attack_frequency_summary(frequency: DataFrame) -> DataFrame:
    """Totals, number of types, most and least common (ties by name)."""
    most = F.min(F.struct((-F.col("n")).alias("k"), "attack_type"))["attack_type"]
    least = F.max(F.struct((-F.col("n")).alias("k"), "attack_type"))["attack_type"]
    return frequency.agg(
        F.sum("n").alias("total_attacks"), F.count(F.lit(1)).alias("unique_attack_types"),
        F.sum("high").alias("high_severity"), F.sum("medium").alias("medium_severity"),
        F.sum("low").alias("low_severity"), most.alias("most_common"), least.alias("least_common"))


def summary(alerts: DataFrame) -> DataFrame:
    """Total, benign, malicious, and valid alerts per model; ``(item, n)``."""
    valid = alerts.filter(is_valid_alert())
    benign = F.contains(F.lower("attack_type"), F.lit("benign"))
    one = valid.agg(F.count(F.lit(1)).alias("total"), F.count_if(benign).alias("benign"))
    totals = one.select(F.inline(F.array(
        F.struct(F.lit("total").alias("item"), F.col("total").alias("n")),
        F.struct(F.lit("benign").alias("item"), F.col("benign").alias("n")),
        F.struct(F.lit("malicious").alias("item"), (F.col("total") - F.col("benign")).alias("n")))))
    per_model = valid.select(F.explode(model_tokens()).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return totals.unionByName(per_model)


def ip_diversity(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct (src, dst) pairs and distinct addresses.

    Exact mode removes duplicates by shuffle before counting; ``approx`` uses
    sketches and needs one pass.
    """
    if approx:
        pairs = df.agg(F.approx_count_distinct(F.struct("src_ip", "dst_ip")).alias("unique_pairs"))
        ips = df.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).agg(
            F.approx_count_distinct("ip").alias("unique_ips"))
    else:
        distinct = df.select("src_ip", "dst_ip").distinct()
        pairs = distinct.agg(F.count(F.lit(1)).alias("unique_pairs"))
        ips = distinct.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).distinct().agg(
            F.count(F.lit(1)).alias("unique_ips"))
    n = ips.agg(F.first(F.struct("unique_ips")).alias("s")).scalar()["unique_ips"]
    return pairs.withColumn("unique_ips", n)


def report_status(alerts: DataFrame, ref_ts: Column, stale_minutes: int = 30) -> DataFrame:
    """Number of alerts, newest time, its age in minutes, stale beyond 30."""
    one = alerts.agg(F.count(F.lit(1)).alias("n_alerts"), F.max("ts").alias("latest"))
    age = (F.unix_micros(ref_ts.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 60_000_000
    return one.withColumn("age_minutes", age).withColumn("is_stale", F.col("age_minutes") > stale_minutes)


def running_detection_time(alerts: DataFrame, key: str, ts: str = "ts", tie: str = "flow_id") -> DataFrame:
    """Cumulative mean detection time per key, in event order (rows alike in time go by ``tie``, then by their hash).

    A prefix sum in parallel: rows are dealt once into ranges of (key, time, tie), each range adds up
    its keys, and what a key has in earlier ranges enters its part of a range as a first row of
    its own.  Ranges are equal in rows, so a key or a second that holds most rows is spread like any other.
    """
    order = [F.col(ts), F.col(tie), F.col("__h")]
    ranged = alerts.withColumn("__h", F.xxhash64(*[c for c, kind in alerts.dtypes if "map<" not in kind])) \
        .repartitionByRange(F.col(key), *order).withColumn("__p", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy(key, "__p").agg(F.sum("detection_time").alias("__s"), F.count("detection_time").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of the key
    carried = totals.select(key, "__p", F.sum("__s").over(earlier).alias("__s"), F.sum("__n").over(earlier).alias("__n")).filter("__n > 0")
    own = ranged.select("*", F.lit(1).alias("__own"), F.col("detection_time").cast("double").alias("__s"),
                        F.when(F.col("detection_time").isNotNull(), 1).otherwise(0).cast("long").alias("__n"))
    both = own.unionByName(carried.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy(key, "__p").orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.try_divide(F.sum("__s").over(upto), F.sum("__n").over(upto))
    return both.select("*", mean.alias("running_mean")).filter("__own = 1").select(*alerts.columns, "running_mean")


def windowed_severity(alerts: DataFrame, length: str = "30 minutes", slide: str = "5 minutes") -> DataFrame:
    """Valid alerts per sliding window and severity."""
    return alerts.filter(is_valid_alert()).groupBy(F.window("ts", length, slide), "severity").agg(
        F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "severity", "n")


def windowed_frequency(alerts: DataFrame, length: str = "1 hour") -> DataFrame:
    """Non-benign valid alerts per tumbling window, attack and severity."""
    return alerts.filter(is_valid_alert() & ~is_benign()).groupBy(
        F.window("ts", length), "attack_type", "severity").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "attack_type", "severity", "n")


def newest_first(alerts: DataFrame) -> DataFrame:
    """Alert listing, newest first: a range-partitioned sort, no single task."""
    return alerts.orderBy(F.desc("ts"), "flow_id")


# --- export forms -------------------------------------------------------------------
def risk_export(report: DataFrame) -> DataFrame:
    pct = F.concat(F.round("percentage", 2).cast("string"), F.lit("%"))
    return report.select(
        F.col("severity").alias("Severity Level"), F.col("n").alias("Count"), pct.alias("Percentage"),
        F.col("top_attacks").alias("Top Attack Types"), F.col("action").alias("Recommended Action"))


def frequency_export(frequency: DataFrame) -> DataFrame:
    pct = F.concat(F.round("percentage", 2).cast("string"), F.lit("%"))
    return frequency.select(
        F.col("attack_type").alias("Attack Type"), F.col("n").alias("Count"), pct.alias("Percentage"),
        F.col("high").alias("High Severity"), F.col("medium").alias("Medium Severity"),
        F.col("low").alias("Low Severity"))
