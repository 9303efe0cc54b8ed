"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, its word stems (first
``STEM`` bytes), its word pairs and its pairs with one word skipped; words are runs
of ASCII letters, digits and non-ASCII bytes.  The learner keeps per-coordinate
rates and an L1 penalty, so most of the ``2**BITS`` weights are exactly zero and
what is left is small enough to send to every task.

The fit uses at most ``max_rows`` labelled rows with at most ``MAX_COORDINATES`` coordinates
(bounds of the one learning task, documented).  Each label has half of the rows and what
the other leaves, so rare toxic rows are not thinned out with the rest; the intercept is put back to
the shares of all labelled rows.  Scoring reads every whole text once, in Arrow batches, without a shuffle.

Defined results: a null or empty text has no feature and scores by the intercept;
repeated rows score alike; of rows that repeat a labelled id with other texts, the one with the smallest
text hash is learned from; no training rows (or one class only) give the base rate
(0.0 without any label); other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.llm.common import MAX_TRAINING_ROWS, arrow_rows, bounded_sample, fold, labels_of, sigmoid
from flowlens.session import materialize

BITS = 22
STEM = 5
GRAMS = ((0,), (0, 1), (0, 2))
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1.0, 0.0
EPOCHS = 4
#: Coordinates of all training rows together; rows beyond it, in the order of their hashes, are not fitted on.
MAX_COORDINATES = 64_000_000
#: A coordinate is admitted once this many training rows have it.
MIN_ROWS = 4
#: Feature value: LENGTH / sqrt(number of features), at most 1, so that long texts do not learn faster.
LENGTH = 8.0


@dataclass(frozen=True)
class ToxicityModel:
    """The non-zero weights, by ascending coordinate, and the intercept."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct feature coordinates of each text, one chunk of texts in memory at a time."""
    for _, _, data, offsets in wh.chunks(column):
        words = wh.words(data, offsets, wh.NOT_ALNUM)
        stems = wh.words(data, offsets, wh.NOT_ALNUM, prefix=STEM).hashes ^ np.uint64(0x5DEECE66D)
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            grams = [wh.ngrams(words.hashes[a:b], g, salt=g[-1] << 8) for g in GRAMS]
            every = np.concatenate([*grams, wh.mix(stems[a:b])])
            yield np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))


def value(at: np.ndarray) -> float:
    return min(1.0, LENGTH / np.sqrt(len(at) + 1.0))


def learn(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> ToxicityModel:
    """FTRL-proximal passes over the rows in the given order."""
    rate = float(labels.mean()) if len(labels) else 0.0
    if rate in (0.0, 1.0):
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), 40.0 if rate else -40.0)
    seen = np.zeros(1 << BITS, np.int32)
    for at in rows:
        seen[at] += 1
    values = [value(at) for at in rows]
    rows = [at[seen[at] >= MIN_ROWS] for at in rows]
    z, n = np.zeros((2, 1 << BITS))
    bias, bias_n = float(np.log(rate / (1 - rate))), 0.0

    def weights(at):
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0.0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, x, y in zip(rows, values, labels):
            w = weights(at)
            loss = float(sigmoid(bias + x * w.sum())) - y
            g, before = loss * x, n[at]
            n[at] = before + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(before)) / ALPHA * w
            bias_n += loss * loss
            bias -= 0.1 * loss / (BETA + np.sqrt(bias_n))
    alive = np.flatnonzero(np.abs(z) > L1).astype(np.int32)
    return ToxicityModel(alive, weights(alive), bias)


def quotas(counts: dict[int, int], most: int) -> dict[int, int]:
    """Rows to take of label 0 and 1: half of ``most`` each, and what the other label leaves."""
    return {k: max(most // 2, most - counts.get(1 - k, 0)) for k in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fold, at most ``max_rows`` of them."""
    known = labels_of(labels, label).filter(fold("doc_id", 3) != 1)
    counts = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    quota = quotas(counts, max_rows)
    chosen = [bounded_sample(known.filter(F.col(label) == k), label, ["doc_id"], quota[k]) for k in (0, 1)]
    both = chosen[0].unionByName(chosen[1]).select("doc_id", F.col(label).alias("_y"))
    sample = docs.select("doc_id", "text").join(F.broadcast(both), "doc_id")  # bounded by max_rows
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("h", pa.int64()), ("at", pa.list_(pa.int32()))])

    def coordinates(batch: pa.RecordBatch):
        return {"doc_id": batch["doc_id"], "y": batch["_y"], "h": batch["h"], "at": list(features(batch["text"]))}

    rows = sample.withColumn("h", F.xxhash64("text")).mapInArrow(arrow_rows(coordinates, schema), "doc_id long, y int, h long, at array<int>")
    rows = materialize(rows.groupBy("doc_id").agg(F.min_by(F.struct("y", "at"), "h").alias("r")).select("doc_id", "r.y", "r.at"), "toxicity-sample")
    if (rows.agg(F.sum(F.size("at"))).first()[0] or 0) > MAX_COORDINATES:
        upto = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most max_rows numbers
        fits = rows.select("doc_id", F.size("at").cast("long").alias("size")).withColumn("upto", upto).filter(F.col("upto") <= MAX_COORDINATES)
        rows = rows.join(F.broadcast(fits.select("doc_id")), "doc_id")
    found = rows.coalesce(1).mapInArrow(_train, "at array<int>, weight array<double>, bias double").collect()
    if not found:
        return learn([], np.zeros(0))
    model = ToxicityModel(np.array(found[0]["at"], np.int32), np.array(found[0]["weight"], float), found[0]["bias"])
    taken = {k: min(quota[k], counts.get(k, 0)) for k in (0, 1)}
    if min(taken.values()) == 0:
        return model
    shift = np.log(counts[1] / counts[0]) - np.log(taken[1] / taken[0])  # from the sample's shares to those of all labels
    return ToxicityModel(model.index, model.weight, model.bias + float(shift))


def _train(batches):
    """The one learning task: it holds the bounded sample's coordinates and returns the sparse weights."""
    found = []
    for batch in batches:
        lists = batch["at"]
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
        parts = np.split(values.astype(np.int32), np.cumsum(ends)[:-1])
        found += list(zip(batch["doc_id"].to_pylist(), parts, batch["y"].to_pylist()))
    found.sort(key=lambda r: int(wh.mix(np.array([r[0]], np.int64).view(np.uint64))[0]))
    model = learn([r[1] for r in found], np.array([r[2] for r in found], float))
    schema = pa.schema([("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64())), ("bias", pa.float64())])
    yield pa.RecordBatch.from_arrays(
        [pa.array([model.index], schema[0].type), pa.array([model.weight], schema[1].type), pa.array([model.bias])],
        schema=schema)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def rate(batch: pa.RecordBatch):
        values = scores(batch["text"], model)
        return {"doc_id": batch["doc_id"], "score": values, "predicted": (values >= threshold).astype(np.int32)}

    return docs.select("doc_id", "text").mapInArrow(
        arrow_rows(rate, schema), "doc_id long, score double, predicted int")


def scores(column: pa.Array, model: ToxicityModel) -> np.ndarray:
    totals = np.full(len(column), model.bias)
    if len(model.index):
        for i, at in enumerate(features(column)):
            where = np.searchsorted(model.index, at)
            where[where == len(model.index)] = 0
            totals[i] += value(at) * model.weight[where[model.index[where] == at]].sum()
    return sigmoid(totals)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Fit on the labelled part, score everything: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels), threshold).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def below(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text"), model) < threshold))

    return docs.mapInArrow(keep, docs.schema)
