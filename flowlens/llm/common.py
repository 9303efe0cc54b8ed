"""What the operators of this subpackage share: fold rules, bounded samples, Arrow task helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a classifier's training sample; labelled rows beyond it are not fitted on.
MAX_TRAINING_ROWS = 8_000


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1))


def uniform(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that only the columns' values and the seed decide."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") / F.lit(float(2**53))


def bounded_sample(df: DataFrame, by: str, order: list[str], most: int, seed: int = 7) -> DataFrame:
    """At most ``most`` rows of each value of ``by``, the same ones in every run.

    A first filter by hash leaves about 1.3 times as many, so the ranking that
    makes the bound strict never sees a whole large group.
    """
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for value, n in counts.items():
        if n > 2 * most:
            share = F.when(F.col(by).eqNullSafe(F.lit(value)), F.lit(1.3 * most / n)).otherwise(share)
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_u", *order))
    picked = df.withColumn("_u", uniform(*order, seed=seed)).filter(F.col("_u") < share)
    return picked.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_u", "_rank")


def labels_of(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row per document: the majority of its non-null labels, ties count as 1."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias(label))
    )


def arrow_rows(fn: Callable[[pa.RecordBatch], dict[str, object]], schema: pa.Schema):
    """A mapInArrow function from one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = fn(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run


@contextmanager
def arrow_batches(spark: SparkSession, most: str):
    """Smaller Arrow batches for what is executed inside the block; the session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def float_lists(matrix: np.ndarray) -> pa.Array:
    """A row-major matrix as an Arrow list column, without Python lists."""
    matrix = np.ascontiguousarray(matrix, np.float64)
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1] if matrix.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700.0, 700.0)))
