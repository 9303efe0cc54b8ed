"""Quality classifier: regularised quadratic discriminant over document statistics.

Each whole text becomes ``len(STATISTICS)`` transformed numbers (lengths as
logarithms, shares as square roots), so that a class is close to a Gaussian.  The
class moments are sums, added up by Spark over *all* labelled rows outside the
held-out fold; only ``2 x p x (p + 1)`` numbers reach the driver.  Every class
covariance is shrunk twice: towards the pooled one and towards its own diagonal.
Its Cholesky factor is computed once and kept; the score is the logistic of the
difference of the two Mahalanobis log-densities plus the log prior odds.

Texts are read once: the statistics are written and both the fit and the scoring
read that small table.

Defined results: null and empty texts have all-zero statistics and are scored like
any other; repeated rows score alike; with no labels at all the score is 0.5, with
one class only it is that class; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.llm.common import arrow_rows, float_lists, fold, labels_of, sigmoid
from flowlens.session import materialize

STATISTICS = (
    "log_words", "log_word_length", "upper", "digit", "symbol", "comma_stop", "newline", "bar",
    "repeated_word", "distinct_words", "symbol_ended", "capital_started", "short_words", "long_words",
)
POOLED_SHARE, DIAGONAL_SHARE, RIDGE = 0.05, 0.05, 1e-4

_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "comma_stop": np.isin(_BYTES, [0x2C, 0x2E]),
    "newline": _BYTES == 0x0A,
    "bar": _BYTES == 0x7C,
    "symbol": (_BYTES < 128) & np.array([not chr(b).isalnum() for b in range(256)]) & ~wh.SPACE
    & ~np.isin(_BYTES, [0x2C, 0x2E]),
}


@dataclass(frozen=True)
class QualityModel:
    """Per class 0 and 1: mean, lower Cholesky factor, log-determinant; and the log prior odds of class 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    log_dets: tuple[float, ...]
    log_odds: float


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    out = np.zeros((len(column), len(STATISTICS)))
    at = {name: k for k, name in enumerate(STATISTICS)}
    for row, end, data, offsets in wh.chunks(column):
        found = wh.words(data, offsets)
        n_bytes, n_words = np.diff(offsets), np.diff(found.bounds)
        per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
        block = out[row:end]

        def share(flags: np.ndarray, borders: np.ndarray, of: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags)])
            return np.sqrt((sums[borders[1:]] - sums[borders[:-1]]) / of)

        for name, kind in _KINDS.items():
            block[:, at[name]] = share(kind[data], offsets, per_byte)
        length = found.ends - found.starts
        total = np.concatenate([[0], np.cumsum(length)])
        block[:, at["log_words"]] = np.log1p(n_words)
        block[:, at["log_word_length"]] = np.log1p((total[found.bounds[1:]] - total[found.bounds[:-1]]) / per_word)
        again = np.zeros(len(length), bool)
        again[1:] = found.hashes[1:] == found.hashes[:-1]
        block[:, at["repeated_word"]] = share(again, found.bounds, per_word)
        ends_in = data[np.maximum(found.ends - 1, 0)] if len(data) else data
        begins = data[found.starts] if len(data) else data
        block[:, at["symbol_ended"]] = share(_KINDS["symbol"][ends_in], found.bounds, per_word)
        block[:, at["capital_started"]] = share(_KINDS["upper"][begins], found.bounds, per_word)
        block[:, at["short_words"]] = share(length <= 3, found.bounds, per_word)
        block[:, at["long_words"]] = share(length >= 9, found.bounds, per_word)
        for i, (a, b) in enumerate(zip(found.bounds[:-1], found.bounds[1:])):
            if b > a:
                block[i, at["distinct_words"]] = np.log(len(np.unique(found.hashes[a:b]))) / max(np.log(b - a), 1.0)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])
    rows = arrow_rows(lambda b: {"doc_id": b["doc_id"], "stats": float_lists(statistics(b["text"]))}, schema)
    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, stats array<double>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel | None:
    """Moments of all labelled rows outside the held-out fold; None without any."""
    known = labels_of(labels, label).filter(fold("doc_id", 3) != 1)
    rows = stats.join(known, "doc_id").select(F.col(label).alias("y"), "stats")
    sums = (
        rows.mapInArrow(_moments, "y int, k int, total double")
        .groupBy("y", "k").agg(F.sum("total").alias("total")).orderBy("y", "k")
    ).collect()  # at most 2 x (1 + p + p x p) rows
    p = len(STATISTICS)
    moments = {}
    for r in sums:
        moments.setdefault(r["y"], np.zeros(1 + p + p * p))[r["k"]] = r["total"]
    return model_of(moments)


def _moments(batches):
    """Count, sums and product sums of this partition by class, as one small batch."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        y = np.asarray(batch["y"])
        x = batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        for c in np.unique(y):
            own = x[y == c]
            part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
            totals[int(c)] = totals.get(int(c), 0) + part
    schema = pa.schema([("y", pa.int32()), ("k", pa.int32()), ("total", pa.float64())])
    for c, part in totals.items():
        k = np.arange(len(part), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(np.full_like(k, c)), pa.array(k), pa.array(part)], schema=schema)


def model_of(moments: dict[int, np.ndarray]) -> QualityModel | None:
    """Shrunk class Gaussians from the class sums."""
    if not moments:
        return None
    p = len(STATISTICS)
    pooled = sum(moments.values())
    centre = pooled[1 : 1 + p] / pooled[0]
    spread = np.maximum(np.diag(pooled[1 + p :].reshape(p, p)) / pooled[0] - centre**2, 0)
    scale = np.sqrt(spread) + 1e-6
    means, covariances, counts = [], [], []
    for c in (0, 1):
        m = moments.get(c, np.zeros(1 + p + p * p))
        n = max(m[0], 1.0)
        raw = m[1 : 1 + p] / n
        cov = m[1 + p :].reshape(p, p) / n - np.outer(raw, raw)
        means.append((raw - centre) / scale)
        covariances.append(cov / np.outer(scale, scale))
        counts.append(m[0])
    if min(counts) == 0:
        return QualityModel(centre, scale, (), (), (), 40.0 if counts[1] else -40.0)
    shared = (counts[0] * covariances[0] + counts[1] * covariances[1]) / sum(counts)
    factors, log_dets = [], []
    for c in (0, 1):
        own = max(POOLED_SHARE, min(1.0, p / counts[c]))
        cov = (1 - own) * covariances[c] + own * shared
        cov = (1 - DIAGONAL_SHARE) * cov + DIAGONAL_SHARE * np.diag(np.diag(cov)) + RIDGE * np.eye(p)
        factor = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(factor))
        log_dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return QualityModel(centre, scale, tuple(means), tuple(factors), tuple(log_dets),
                        float(np.log(counts[1] / counts[0])))


def scores(x: np.ndarray, model: QualityModel | None) -> np.ndarray:
    """Probability of class 1 from the log-density difference; ``factors`` are inverse Cholesky factors."""
    if model is None:
        return np.full(len(x), 0.5)
    if not model.means:
        return sigmoid(np.full(len(x), model.log_odds))
    z = (x - model.centre) / model.scale
    log_density = [
        -0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(model.means, model.factors, model.log_dets)
    ]
    return sigmoid(log_density[1] - log_density[0] + model.log_odds)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    stats = materialize(measured(docs), "quality-stats")
    model = fit(stats, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def rate(batch: pa.RecordBatch):
        x = batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
        values = scores(x, model)
        return {"doc_id": batch["doc_id"], "score": values, "predicted": (values >= threshold).astype(np.int32)}

    return stats.mapInArrow(arrow_rows(rate, schema), "doc_id long, score double, predicted int").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
