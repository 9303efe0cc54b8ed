"""Filter interaction audit: what each filter removes in every order, from sorted posting lists.

One scan decides every filter for every whole text and keeps a row of a few bytes.  These rows are dealt
by ranges of (part, doc_id); a task turns each run of ``BLOCK`` rows of a part into posting
lists: for every filter the sorted places of the failing documents inside the block, for
every mark (good, toxic) the places of the marked ones.  A merge step galloping over the
lists (binary search of the shorter list in the longer one) builds the union of every subset of filters once,
takes the difference of each filter's list with the union of those applied before it, and
adds sizes up.  Only these sums leave a task: ``2**(k - 1) * k`` rows a part for k filters.
All k! orders are read off them, since what a step removes depends on the set applied
before, not on its order.

A hot part is cut by its ids, a group of copies by the digest's partial minimum; the row table is joined
by (digest, doc_id), never by the digest alone.

Defined results: a null text is empty, a null part is the empty string; rows that repeat an id are
documents of their own; a null id is no smaller than any other and has no smaller one, so it
never fails the copy filter; a document is good (toxic) if any of its label rows says 1; labels of unknown
or null ids are ignored; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import materialize

#: Rows of one part that are turned into posting lists at a time.
BLOCK = 1 << 16

#: Failure conditions by letter, over the text and its words; ``None`` is the copy filter.
FILTERS: dict[str, Callable[[Column, Column], Column] | None] = {
    "A": lambda text, words: F.size(words) < 50,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
    "E": None,
}

#: Marks of labelled documents: name and label column.
MARKS = {"good": "quality", "toxic": "toxic"}

POSTINGS_DDL = "part string, ids array<long>, fails array<array<int>>, marks array<array<int>>"


def decisions(docs: DataFrame, labels: DataFrame, part: str = "source", filters=FILTERS, marks=MARKS) -> DataFrame:
    """part, doc_id, fails (bit i: the i-th filter), marks (bit j: the j-th mark) of every row."""
    slim = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    text, words = F.col("text"), F.col("words")
    split = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    own = [F.when(fails(text, words), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values()) if fails is not None]
    scan = slim.withColumn("words", split).select(
        "part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), sum(own, F.lit(0)).alias("fails"))
    rows = materialize(scan, "audit-rows")
    for i, fails in enumerate(filters.values()):
        if fails is None:
            first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull()).withColumn("first", F.lit(True))
            copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
            rows = rows.join(first, ["digest", "doc_id"], "left").select(
                "part", "doc_id", "digest", (F.col("fails") + F.when(copy, F.lit(1 << i)).otherwise(F.lit(0))).alias("fails"))
    bits = [F.when(F.max(F.col(c) == 1), F.lit(1 << j)).otherwise(F.lit(0)) for j, c in enumerate(marks.values())]
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(sum(bits, F.lit(0)).alias("marks"))
    return rows.join(marked, "doc_id", "left").select("part", "doc_id", "fails", F.coalesce("marks", F.lit(0)).alias("marks"))


def _block_lists(filters: int, marks: int) -> Callable:
    """Task that turns rows sorted by (part, doc_id) into posting lists, a block at a time."""
    places = pa.list_(pa.list_(pa.int32()))
    schema = pa.schema([("part", pa.string()), ("ids", pa.list_(pa.int64())), ("fails", places), ("marks", places)])

    def lists(bits: np.ndarray, count: int) -> list[np.ndarray]:
        return [np.flatnonzero(bits >> k & 1).astype(np.int32) for k in range(count)]

    def block(part: str, rows: pa.Table) -> pa.RecordBatch:
        fails, marked = (rows[c].to_numpy() for c in ("fails", "marks"))
        ids = rows["doc_id"].combine_chunks()
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            pa.array([lists(fails, filters)], places), pa.array([lists(marked, marks)], places)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, n = [], None, 0
        for batch in batches:
            names = batch["part"].dictionary_encode()
            codes = names.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                name = names.dictionary[int(codes[a])].as_py()
                if held and name != part:
                    yield block(part, pa.Table.from_batches(held))
                    held, n = [], 0
                part = name
                while a < b:
                    take = min(b - a, BLOCK - n)
                    held.append(batch.slice(a, take))
                    a, n = a + take, n + take
                    if n == BLOCK:
                        yield block(part, pa.Table.from_batches(held))
                        held, n = [], 0
        if held:
            yield block(part, pa.Table.from_batches(held))

    return run


def postings(rows: DataFrame, filters: int = len(FILTERS), marks: int = len(MARKS)) -> DataFrame:
    """Posting lists of id ranges: part, ids (sorted), and for each filter and mark the places of its documents in ids."""
    dealt = rows.repartitionByRange("part", F.col("doc_id").asc_nulls_first()).sortWithinPartitions("part", "doc_id")
    return dealt.mapInArrow(_block_lists(filters, marks), POSTINGS_DDL)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted values of ``a`` that are not in sorted ``b``; gallops over the longer list."""
    if len(a) == 0 or len(b) == 0:
        return a
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        at[at == len(b)] = 0
        return a[b[at] != a]
    at = np.searchsorted(a, b)
    hit = at[at < len(a)]
    keep = np.ones(len(a), bool)
    keep[hit[a[hit] == b[at < len(a)]]] = False
    return a[keep]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sorted values of either sorted list."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    fresh = difference(short, long)
    return np.insert(long, np.searchsorted(long, fresh), fresh)


def interactions(fails: list[np.ndarray], marks: list[np.ndarray], n: int) -> np.ndarray:
    """One row per (filter, set applied before): set, filter, failing, removed, kept, then what each mark loses."""
    k = len(fails)
    unions = [np.zeros(0, np.int32)]
    for subset in range(1, 1 << k):
        low = (subset & -subset).bit_length() - 1
        unions.append(union(unions[subset & (subset - 1)], fails[low]))
    out = []
    for before in range(1 << k):
        for f in range(k):
            if before >> f & 1:
                continue
            gone = difference(fails[f], unions[before])
            lost = [len(gone) - len(difference(gone, m)) for m in marks]
            out.append([before, f, len(fails[f]), len(gone), n - len(unions[before | 1 << f]), *lost])
    return np.array(out, np.int64)


def merge(lists: DataFrame, marks: tuple[str, ...] = tuple(MARKS)) -> DataFrame:
    """part, before (set of filters, as bits), filter, failing, removed, kept, lost_<mark>: summed over all blocks."""
    names = ["before", "filter", "failing", "removed", "kept", *(f"lost_{m}" for m in marks)]
    ddl = "part string, " + ", ".join(f"{c} long" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part] * len(total), pa.string()), *(pa.array(total[:, c]) for c in range(len(names)))], names=["part", *names])

        for batch in batches:
            for k in range(len(batch)):
                arrays = [[v.values.to_numpy() for v in batch[c][k]] for c in ("fails", "marks")]
                now = interactions(*arrays, len(batch["ids"][k].values))
                name = batch["part"][k].as_py()
                if total is not None and name != part:
                    yield result()
                    total = None
                if total is None:
                    part, total = name, now
                else:
                    total[:, 2:] += now[:, 2:]
        if total is not None:
            yield result()

    return lists.mapInArrow(run, ddl).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in names[2:]])


def orders(spark: SparkSession, letters: tuple[str, ...]) -> DataFrame:
    """filter_order, step, filter, before: the k * k! steps of all orders, a fixed table."""
    k = len(letters)
    rows = [("".join(letters[f] for f in order), step + 1, order[step], sum(1 << f for f in order[:step]))
            for order in permutations(range(k)) for step in range(k)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter long, before long")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", filters=FILTERS, marks=MARKS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, <mark>_lost, shapley: every part, order and step."""
    k = len(filters)
    sums = merge(postings(decisions(docs, labels, part, filters, marks), k, len(marks)), tuple(marks))
    # an order in which exactly ``before`` comes first: before! * (k - 1 - before)! of the k!
    times = F.lit(0)
    for size in range(k):
        times = F.when(F.bit_count("before") == size, F.lit(factorial(size) * factorial(k - 1 - size))).otherwise(times)
    others = F.lit((1 << k) - 1) - F.call_function("shiftleft", F.lit(1), F.col("filter").cast("int"))
    same = Window.partitionBy("part", "filter")
    facts = sums.withColumn("shapley", F.sum(F.col("removed") * times).over(same)).withColumn(
        "unique_fails", F.max(F.when(F.col("before") == others, F.col("removed"))).over(same))
    steps = F.broadcast(orders(docs.sparkSession, tuple(filters)))  # k * k! rows, 600 for five filters
    return facts.join(steps, ["before", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails",
        *[F.col(f"lost_{m}").alias(f"{m}_lost") for m in marks], "shapley")
