"""Steps whose tasks, driver or files must not grow faster than the tables."""

import glob
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from flowlens.operators import balance as bl
from flowlens.plans import preprocess
from flowlens.queries import QUERIES, learning, load, scans, streams
from flowlens.session import run_id, shared_dir, small_methods
from flowlens.sources import readers, sinks
from flowlens.streaming import flows as sf_


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_not_broadcast(spark):
    """A tiny plan explodes into any number of draws; the join must not send them through the driver."""
    df = spark.range(2000).select("id", F.when(F.col("id") < 100, "a").otherwise("b").alias("c"))
    drawn = bl.resample(df, "id", "c", "minority")
    joins = re.findall(r"(\w+Join) \[[^\]]*row_idx", plan_of(drawn))
    assert joins == ["SortMergeJoin"]
    assert {r["c"]: r["n"] for r in drawn.groupBy("c").agg(F.sum("copies").alias("n")).collect()} == {"a": 380, "b": 1900}


def test_fit_rows_are_drawn_by_all_tasks(spark, sf, monkeypatch):
    """The sample is brought together by an exchange; a coalesce makes one task read the whole split."""
    written = {}
    real = learning.materialize
    monkeypatch.setattr(learning, "materialize", lambda df, label: real(written.setdefault(label, df), label))
    train, _ = learning.split_flows(spark, sf, 100)
    assert "Coalesce" not in plan_of(written["fit"]) and "Exchange SinglePartition" in plan_of(written["fit"])
    assert len(train.inputFiles()) == 1 and 90 <= train.count() <= 110


def lineitem(spark, tmp_path, rows):
    """A flow table of its own: every 50th row has no order key, every 40th repeats the row before it."""
    n = F.col("id") - F.when(F.col("id") % 40 == 39, 1).otherwise(0)
    spark.range(rows).withColumn("n", n).selectExpr(
        "if(n % 50 = 10, null, n div 4) as l_orderkey", "(n * 37) % 500 as l_partkey", "n % 90 as l_suppkey", "cast(n % 4 as int) as l_linenumber",
        "cast(n % 50 + 1 as double) as l_quantity", "cast(n * 13 % 9000 as double) as l_extendedprice", "(n % 11) / 100D as l_discount",
        "(n % 9) / 100D as l_tax", "timestamp_ntz'2022-01-01 00:00:00' as l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_models_fit_on_every_train_row(spark, tmp_path):
    """All rows are on one side or the other, in a fold, and counted by the queries that return the rows fitted on."""
    load()
    own = lineitem(spark, tmp_path, 9000)
    train, test = learning.split_flows(spark, own)
    n = train.count()
    assert n > 6000 and n + test.count() == 9000
    assert {r["fold"]: r["count"] > n / 4 for r in learning.folded(train).groupBy("fold").count().collect()} == {0: True, 1: True, 2: True}
    assert QUERIES["fs6_recursive_elimination"](spark, own).first()["n"] == n
    assert {r["n"] for r in QUERIES["m11_grid_search"](spark, own).collect()} == {n}


def test_files_of_a_feed_are_bounded(spark, tmp_path, monkeypatch):
    """A larger table has more files, not larger ones, and as many micro-batches as before."""
    load()
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    monkeypatch.setattr(streams, "new_path", lambda spark, label: str(tmp_path / label))
    query = sf_.run_to_table(streams.replay(spark, spark.range(1000)), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    sizes = [pq.read_metadata(f).num_rows for f in glob.glob(f"{tmp_path}/feed/*.parquet")]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 60
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 2
    assert spark.read.parquet(str(tmp_path / "out")).distinct().count() == 1000


def test_export_is_written_compressed(spark, sf, tmp_path):
    load()
    assert len(QUERIES["s01_export_scan"](spark, sf).collect()) > 70
    files = glob.glob(f"{shared_dir(spark)}/flowlens/{run_id(spark)}/export-*/part-*")
    assert files and all(f.endswith(".csv.gz") for f in files)
    rows = spark.range(95).select(F.concat(F.lit("f, "), "id").alias("Flow ID"), (F.col("id") / 4).alias("Flow Duration"))
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "x"), "gzip", 10)
    assert len(glob.glob(f"{tmp_path}/x/part-*.csv.gz")) == 10
    assert {tuple(r) for r in readers.read_export(spark, str(tmp_path / "x")).collect()} == {(f"f, {i}", i / 4) for i in range(95)}


def test_detection_log_is_written_compressed(spark, tmp_path, monkeypatch):
    """Appended files are compressed and hold a bounded number of rows; the log reads back whole."""
    monkeypatch.setattr(sinks, "LOG_FILE_ROWS", 10)
    rows = spark.range(45).selectExpr("timestamp_ntz'2022-01-01 00:00:00' as ts", "concat('f', id) as flow_id", "cast(id % 9 as int) as pred",
                                      "id / 45 as conf", "cast(id as double) as d").coalesce(1)
    for model in ("ACA_SVM", "Fuzzy_RF"):
        sinks.append_detections(sinks.detection_log(rows, model, "pred", "conf", ["d"]), str(tmp_path / "log"))
    files = glob.glob(f"{tmp_path}/log/part-*")
    assert len(files) == 10 and all(f.endswith(".json.gz") for f in files)
    back = readers.read_detection_log(spark, str(tmp_path / "log"))
    assert {(r["model_name"], r["flow_id"], r["features"]["d"]) for r in back.collect()} == {(m, f"f{i}", float(i)) for m in ("ACA_SVM", "Fuzzy_RF") for i in range(45)}


def test_wide_rows_run_in_compiled_methods(spark, sf, monkeypatch):
    """The export is written and read unfused; the session's own setting comes back, also after an error."""
    load()
    name, seen, real = "spark.sql.codegen.hugeMethodLimit", [], {}
    before = spark.conf.get(name)
    for module, step in ((sinks, "write_csv"), (scans, "materialize")):
        real[step] = getattr(module, step)
        monkeypatch.setattr(module, step, lambda *a, step=step: seen.append((step, spark.conf.get(name))) or real[step](*a))
    assert QUERIES["s01_export_scan"](spark, sf).count() > 70
    assert seen == [("write_csv", "8000"), ("materialize", "8000")] and spark.conf.get(name) == before
    written = []
    real["preprocess"] = preprocess.materialize
    monkeypatch.setattr(preprocess, "materialize", lambda df, label: written.append((label, spark.conf.get(name))) or real["preprocess"](df, label))
    assert QUERIES["e13_preprocessing"](spark, sf).count() > 10
    assert written == [("clean", "8000"), ("engineered", "8000"), ("scaled", "8000")] and spark.conf.get(name) == before
    try:
        with small_methods(spark):
            raise ValueError
    except ValueError:
        pass
    assert spark.conf.get(name) == before
