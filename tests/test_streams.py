"""Stores that streams keep, their late rows, joins and state on disk."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.streaming import flows as fl, late
from flowlens.streaming.store import Store, newest, summed


def runs_of(store):
    return {name: len(runs) for name, runs in store.manifest().runs.items()}


def test_many_batches_few_runs(spark, tmp_path):
    """Over 300 batches: the table equals all batches, a reader touches few runs, and old files go."""
    store = Store(spark, str(tmp_path / "s"), {"rows": summed(["k"])}, fanout=8)
    want = Counter()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    for b in range(305):
        want.update({b % 5: 1})
        want.update({b % 7: 2})
        store.append(b, {"rows": spark.range(2).select(
            F.when(F.col("id") == 0, b % 5).otherwise(b % 7).cast("long").alias("k"), (F.col("id") + 1).alias("n")).coalesce(1)})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {r["k"]: r["n"] for r in store.read("rows").collect()} == dict(want)
    assert runs_of(store)["rows"] <= 3 * 8 and len(os.listdir(tmp_path / "s" / "runs")) <= 6 * 8
    assert len([n for n in os.listdir(tmp_path / "s" / "manifest") if n.endswith(".json")]) <= 4
    assert store.manifest().upto == 304


def test_retried_and_failed_batches_count_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), {"rows": newest(["k"], ["at"]), "other": None}, fanout=2)
    frame = lambda *rows: spark.createDataFrame(rows, "k int, at int, v string")
    assert store.append(0, {"rows": frame((1, 5, "a"), (1, 4, "b"), (2, 1, "c"))})
    assert not store.append(0, {"rows": frame((1, 9, "again"))})
    with pytest.raises(Exception):
        store.append(1, {"rows": frame((1, 6, "x")), "other": frame((1, 1, "y")).select(F.raise_error(F.lit("no")).alias("k"))})
    assert store.append(1, {"rows": frame((1, 2, "old"), (3, 1, None))})
    assert {(r["k"], r["v"]) for r in store.read("rows").collect()} == {(1, "a"), (2, "c"), (3, None)}
    assert store.read("other") is None and store.read("other", "k int").count() == 0
    again = Store(spark, str(tmp_path / "s"), store.merges)  # another session sees the same
    assert again.read("rows").count() == 3


def feed(spark, path, batches, schema):
    """One file per batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={k:03d}")
    full = spark.read.schema(schema).parquet(f"{path}/*")
    return spark.readStream.schema(full.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path), full


def test_late_rows_are_kept(spark, tmp_path):
    """Windows plus side table equal the batch report; exactly the rows behind the watermark are in the side table."""
    batches = [[(100, "a"), (700, "a")], [(650, "b"), (None, "n")], [(5000, "a"), (4000, "b")], [(4500, "a"), (100, "late"), (4390, "late")], [(5001, "z")]]
    rows = [[(t, k) for t, k in b] for b in batches]
    stream, full = feed(spark, str(tmp_path / "feed"), rows, "s long, k string")
    with_time = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    count = lambda df: df.groupBy(F.window("ts", "10 minutes")["start"].alias("w"), "k").agg(F.count(F.lit(1)).alias("n"))
    store = late.run_windows(with_time(stream), str(tmp_path / "w"), str(tmp_path / "c"), count, ["w", "k"])
    assert sorted(r["s"] for r in store.read("late").collect()) == [100, 4390]
    assert store.manifest().facts == {"watermark": (5001 - 600) * 10**6, "late_rows": 2}
    both = store.read("windows").unionByName(count(store.read("late"))).groupBy("w", "k").agg(F.sum("n").alias("n"))
    assert Counter(map(tuple, both.collect())) == Counter(map(tuple, count(with_time(full)).collect()))


def test_interval_join_equals_the_batch_join(spark, tmp_path):
    """Matches over any batches are found once; rows behind the watermark are kept aside; old rows leave the state."""
    alerts = [[(f"f{b}-{k}", 1000 * b + 10 * k) for k in range(5)] for b in range(8)]
    alerts[6].append(("f0-9", 50))  # far behind
    verdicts = [[(f"f{b}-{k}", 1000 * b + 10 * k + d, k % 2 == 0) for k, d in ((0, 0), (1, 600), (2, 601), (3, -1))] for b in range(8)]
    left, all_left = feed(spark, str(tmp_path / "a"), alerts, "flow_id string, s long")
    right, all_right = feed(spark, str(tmp_path / "v"), verdicts, "flow_id string, s long, is_threat boolean")
    a = lambda df: df.select("flow_id", F.timestamp_seconds("s").alias("ts"))
    v = lambda df: df.select("flow_id", F.timestamp_seconds("s").alias("at"), "is_threat")
    store = late.run_interval_join(a(left), v(right), str(tmp_path / "j"), str(tmp_path / "c"), "flow_id", "ts", "at", within="10 minutes", delay="5 minutes")
    got = Counter((r["flow_id"], r["is_threat"]) for r in store.read("joined").collect())
    assert got == Counter((f"f{b}-{k}", k % 2 == 0) for b in range(8) for k in (0, 1))
    assert [r["flow_id"] for r in store.read("late_left").collect()] == ["f0-9"]
    facts = store.manifest().facts
    assert facts["late_left"] == 1 and facts["late_right"] == 0
    assert store.read("left").count() <= all_left.count()


def test_first_seen_pairs_on_disk(spark, tmp_path):
    stream, _ = feed(spark, str(tmp_path / "f"), [[("a", "b", 1), ("a", "b", 2)], [("a", "b", 3), ("b", "a", 4)], [("a", "b", 5)]], "src_ip string, dst_ip string, n int")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    query = fl.run_to_table(fl.first_seen_pairs(stream), str(tmp_path / "o"), str(tmp_path / "c"), on_disk=True)
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert Counter((r["src_ip"], r["dst_ip"]) for r in rows) == Counter([("a", "b"), ("b", "a")])
    assert any("rocksdb" in k for p in query.recentProgress for s in p["stateOperators"] for k in s["customMetrics"])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
