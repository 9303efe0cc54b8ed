"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "flowlens", cores: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster job brings its own."""
    n = cores or os.cpu_count() or 8
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it a cluster session is an
    error, since executors would write to disks that the others cannot read.  Only a
    ``local`` master gets a temporary folder, made once and remembered.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        named = tempfile.mkdtemp(prefix="flowlens-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, never overwritten."""
    return f"{shared_dir(spark)}/flowlens/{run_id(spark)}/{label}-{uuid.uuid4().hex}"


def run_id(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return spark.sparkContext.applicationId


def drop_intermediate(spark: SparkSession) -> bool:
    """Remove every intermediate table this application has written; call it when results are stored.

    Uses the file system of the folder itself; true if there was something to remove.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/flowlens/{run_id(spark)}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a written table: survives executor loss, read back lazily."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For rows of many columns: what is executed inside the block runs in methods that the JVM compiles.

    A fused stage is one generated method; beyond 8,000 bytes the JVM interprets it.  Unfused operators
    split their code.  The session's own setting comes back.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)
