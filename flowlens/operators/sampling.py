"""Exact-size samples and splits without a one-task window or a driver heap.

Rows are ordered by the md5 of their key.  The leading hex digits of the hash
give up to 65,536 buckets; per-bucket counts locate the bucket in which a quota
is used up.  Every row of an earlier bucket is taken by a plain filter, and
only the rows of that one bucket are ranked.  A class that holds a third of all
rows is thus ranked on about 1/65,536 of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.keys import hash_bucket, hash_uniform, key_hash
from flowlens.functions.numeric import as_col
from flowlens.session import materialize

BUCKET_DIGITS = 4
_GROUP, _HASH, _TIE, _BUCKET, _QUOTA = "__group", "__hash", "__tie", "__bucket", "__quota"


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row: rows with equal keys keep one order in every run, unless they are equal."""
    parts = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def _hashed(df: DataFrame, key: str | Column, seed: int, group: str | Column | None) -> DataFrame:
    h = key_hash(as_col(key), seed)
    g = F.lit("all") if group is None else F.coalesce(as_col(group).cast("string"), F.lit(""))
    return df.withColumns({_GROUP: g, _HASH: h, _TIE: row_hash(df)}).withColumn(_BUCKET, hash_bucket(F.col(_HASH), BUCKET_DIGITS))


def _bucket_counts(hashed: DataFrame) -> DataFrame:
    """Rows per (group, bucket) with the rows before the bucket and in the group."""
    counts = hashed.groupBy(_GROUP, _BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    in_group = Window.partitionBy(_GROUP)
    running = in_group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({
        "__upto": F.sum("__n").over(running),
        "__size": F.sum("__n").over(in_group),
    }).withColumn("__before", F.col("__upto") - F.col("__n"))


def _take(df: DataFrame, hashed: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows below each group's cut bucket plus the ranked head of that bucket.

    ``cuts`` is a written table with one row per group, so its true size is
    known: Spark broadcasts it below its threshold and shuffles beyond.
    """
    joined = hashed.join(cuts, _GROUP)
    whole = joined.filter(F.col(_BUCKET) < F.col("__cut"))
    edge = joined.filter(F.col(_BUCKET) == F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(_GROUP).orderBy(_HASH, _TIE))
    part = edge.withColumn("__r", rank).filter(F.col("__r") <= F.col("__left"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def _cuts(counts: DataFrame, quota: Column) -> DataFrame:
    """(group, cut bucket, rows still missing at its start); written once."""
    q = counts.withColumn(_QUOTA, F.least(F.greatest(quota.cast("bigint"), F.lit(0)), F.col("__size")))
    last = q.filter((F.col("__before") < F.col(_QUOTA)) & (F.col("__upto") >= F.col(_QUOTA)))
    return materialize(
        last.select(_GROUP, F.col(_BUCKET).alias("__cut"), (F.col(_QUOTA) - F.col("__before")).alias("__left")), "cuts")


def sample_exact(df: DataFrame, key: str | Column, n: int, seed: int = 42) -> DataFrame:
    """Uniform sample of exactly min(n, rows) rows; empty when n <= 0."""
    if n <= 0:
        return df.limit(0)
    hashed = _hashed(df, key, seed, None)
    return _take(df, hashed, _cuts(_bucket_counts(hashed), F.lit(n)))


def random_rows(df: DataFrame, key: str | Column, n: int, seed: int = 42) -> DataFrame:
    """Sample for scoring: the size is clamped to 1..rows."""
    return sample_exact(df, key, max(1, n), seed)


def bottom_k(df: DataFrame, key: str | Column, n: int, seed: int = 42) -> DataFrame:
    """Reservoir-style sample for small n: per-partition top-k, then one merge."""
    h = key_hash(as_col(key), seed)
    return df.withColumns({_HASH: h, _TIE: row_hash(df)}).orderBy(_HASH, _TIE).limit(max(n, 0)).drop(_HASH, _TIE)


def sample_stratified(df: DataFrame, key: str | Column, group: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows in all: every group keeps its share, rounded half up, at least one."""
    hashed = _hashed(df, key, seed, group)
    counts = _bucket_counts(hashed)
    everything = Window.partitionBy(F.lit(0))  # the bucket counts, not the rows
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("__size") / F.sum("__n").over(everything) + F.lit(0.5)))
    return _take(df, hashed, _cuts(counts, quota))


def sample_thirds(df: DataFrame, key: str | Column, n: int, seed: int = 42) -> DataFrame:
    """Replay sample: equal quotas from three hash thirds, the rest anywhere, at most n."""
    third = F.floor(hash_uniform(key_hash(as_col(key), seed + 1)) * 3).cast("int")
    hashed = _hashed(df, key, seed, third)
    quota = F.lit(n // 3) + F.when(F.col(_GROUP) == "0", F.lit(n - 3 * (n // 3))).otherwise(0)
    return _take(df, hashed, _cuts(_bucket_counts(hashed), quota))


def split_exact(df: DataFrame, key: str | Column, label: str | None, test_fraction: float = 0.3,
                seed: int = 42) -> DataFrame:
    """``split`` column with an exact per-class test quota, rounded half up.

    The cut-off hash of each class is found first; the split itself is then a
    comparison with that cut-off, so no row is moved.  Rows with equal keys share
    a side.
    """
    hashed = _hashed(df, key, seed, label)
    quota = F.floor(F.col("__size") * F.lit(test_fraction) + F.lit(0.5))
    cuts = _cuts(_bucket_counts(hashed), quota)
    edge = hashed.select(_GROUP, _BUCKET, _HASH, _TIE).join(cuts, _GROUP).filter(F.col(_BUCKET) == F.col("__cut"))
    rank = F.row_number().over(Window.partitionBy(_GROUP).orderBy(_HASH, _TIE))
    limit = materialize(edge.withColumn("__r", rank).filter(F.col("__r") == F.col("__left")).select(
        _GROUP, F.col(_HASH).alias("__limit")), "limits")
    return (
        hashed.join(limit, _GROUP, "left")
        .withColumn("split", F.when(F.col(_HASH) <= F.col("__limit"), "test").otherwise("train"))
        .select(*df.columns, "split")
    )


def split_hash(df: DataFrame, key: str | Column, test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """Plain split: one expression, no shuffle; shares are exact in expectation."""
    u = hash_uniform(key_hash(as_col(key), seed))
    return df.withColumn("split", F.when(u < test_fraction, "test").otherwise("train"))


def split_report(split: DataFrame, label: str) -> DataFrame:
    """Class counts per side and the small-class warning of the test side."""
    counts = split.groupBy(label).agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"))
    floor = F.greatest(F.lit(100.0), F.sum("n_test").over(Window.partitionBy(F.lit(0))) * 0.01)  # one row per class
    return counts.withColumn("small_class", F.col("n_test") < floor)


def numbered(df: DataFrame, key: str | Column, group: str, seed: int = 42) -> DataFrame:
    """``row_idx``: dense 0-based number inside each group, in hash order.

    Rows are ranked per (group, bucket) and shifted by the bucket's offset, so a
    hot group is numbered by thousands of tasks, not one.
    """
    hashed = _hashed(df, key, seed, group)
    offsets = _bucket_counts(hashed).select(
        F.col(_GROUP).alias("__g2"), F.col(_BUCKET).alias("__b2"), "__before", F.col("__size").alias("group_size"))
    rank = F.row_number().over(Window.partitionBy(_GROUP, _BUCKET).orderBy(_HASH, _TIE))
    return (
        hashed.withColumn("__r", rank)
        .join(offsets, (F.col(_GROUP) == F.col("__g2")) & (F.col(_BUCKET) == F.col("__b2")))
        .select(*df.columns, (F.col("__before") + F.col("__r") - 1).alias("row_idx"), "group_size")
    )
