"""Language ID: blended-spectrum string kernel, Nyström landmarks, one-versus-rest kernel ridge regression.

A text's spectrum is the set of its hashed character n-grams of 1 to ``LONGEST``
bytes (presence, not counts) over letters and single spaces.  The kernel of two
texts is the number of shared n-grams over the root of the product of their set
sizes.  ``LANDMARKS`` texts per language span the Nyström feature space
``k(x, L) K(L, L)^(-1/2)``; ridge regression with one target per language is solved
there.  Because the presence kernel is a dot product, landmarks, whitening and
ridge weights fold into one ``2**BITS x languages`` matrix, and a batch of texts is
scored by a single product of its presence matrix with it.

The fit uses at most ``TRAIN_ROWS`` texts per language (bounded, documented);
scoring reads every whole text once without a shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0.0;
so is every text when nothing could be learned; repeated rows get equal results;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.llm.common import arrow_rows, bounded_sample, fold

BITS = 14
LONGEST = 4
LANDMARKS, TRAIN_ROWS = 32, 600
#: Training rows of all languages together.
MOST_ROWS = 20_000
RIDGE = 1e-3
SHARPNESS = 8.0
BATCH = 128
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix: which hashed n-grams each text has."""
    out = np.zeros((len(offsets) - 1, 1 << BITS), np.float32)
    if len(data) == 0:
        return out
    letters = np.where(wh.NOT_ALNUM | ((np.arange(256) >= 48) & (np.arange(256) <= 57)), 32, wh._LOWER)[data]
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))[keep]
    codes = letters[keep].astype(np.uint64)
    flat = out.reshape(-1)
    gram = np.zeros(len(codes), np.uint64)
    for size in range(1, LONGEST + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        gram = (gram[:n] << np.uint64(8)) | codes[size - 1 :]
        whole = owner[:n] == owner[size - 1 :]
        at = ((gram + np.uint64(size << 40)) * np.uint64(wh.BASE)) >> np.uint64(64 - BITS)
        flat[(owner[:n] << BITS)[whole] + at.astype(np.int64)[whole]] = 1.0
    return out


def blocks(column: pa.Array):
    """(first row, presence matrix) of at most BATCH texts at a time."""
    for first, end, data, offsets in wh.chunks(column):
        for a in range(0, end - first, BATCH):
            b = min(a + BATCH, end - first)
            own = offsets[a : b + 1]
            yield first + a, presence(data[own[0] : own[-1]], own - own[0])


def normed(x: np.ndarray) -> np.ndarray:
    """Rows divided by the root of their set sizes, so that a dot product is the kernel."""
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0))


def spectra(column: pa.Array) -> np.ndarray:
    """The presence matrix as bits: one row of ``2**BITS / 8`` bytes per text."""
    rows = [np.packbits(x.astype(bool), axis=1) for _, x in blocks(column)]
    return np.concatenate(rows) if rows else np.zeros((0, 1 << BITS >> 3), np.uint8)


def learn(texts: list[str], languages: list[str]) -> LanguageModel:
    """``learn_spectra`` of texts at hand."""
    return learn_spectra(spectra(pa.array(texts, pa.large_string())), languages)


def learn_spectra(bits: np.ndarray, languages: list[str]) -> LanguageModel:
    """Kernel ridge regression in the Nyström space of the first texts of each language."""
    names = tuple(sorted(set(languages)))
    if not names:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32))

    def kernel_rows(rows: np.ndarray) -> np.ndarray:
        return normed(np.unpackbits(rows, axis=1).astype(np.float32))

    of = np.array(languages)
    marks = kernel_rows(bits[np.concatenate([np.flatnonzero(of == name)[:LANDMARKS] for name in names])])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    alive = values > 1e-6 * values.max()
    whiten = vectors[:, alive] / np.sqrt(values[alive])
    gram, cross = np.zeros((alive.sum(),) * 2), np.zeros((alive.sum(), len(names)))
    counts = np.array([(of == name).sum() for name in names])
    for row in range(0, len(bits), BATCH):
        space = (kernel_rows(bits[row : row + BATCH]) @ marks.T) @ whiten
        own = of[row : row + BATCH]
        target = np.where(own[:, None] == np.array(names), 1.0, -1.0)
        each = (1.0 / counts)[np.searchsorted(names, own)][:, None] * counts.mean()
        gram += space.T @ (each * space)
        cross += space.T @ (each * target)
    ridge = np.linalg.solve(gram + RIDGE * len(bits) * np.eye(len(gram)), cross)
    return LanguageModel(names, (marks.T @ (whiten @ ridge)).astype(np.float32))


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from non-null texts and langs outside the held-out fold, at most ``rows`` a language.

    With many languages each has fewer rows, ``MOST_ROWS`` in all; tasks send 2 KB of bits per text, never texts.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (fold("doc_id", 5) > 0))
    languages = known.select("lang").distinct().count()
    rows = min(rows, max(1, MOST_ROWS // max(languages, 1)))
    chosen = bounded_sample(known.select("doc_id", "lang", "text"), "lang", ["doc_id", "text"], rows)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch["lang"], batch["doc_id"], batch["h"], pa.array([r.tobytes() for r in spectra(batch["text"])], pa.binary())],
                names=["lang", "doc_id", "h", "bits"])

    found = chosen.withColumn("h", F.xxhash64("text")).select("lang", "doc_id", "h", "text").mapInArrow(
        bits, "lang string, doc_id long, h long, bits binary").collect()  # MOST_ROWS rows at most
    order = sorted(found, key=lambda r: (r["lang"], int(wh.mix(np.array([r["doc_id"] or 0], np.int64).view(np.uint64))[0]), r["h"]))
    rows = [np.frombuffer(r["bits"], np.uint8) for r in order]
    return learn_spectra(np.array(rows, np.uint8).reshape(len(rows), 1 << BITS >> 3), [r["lang"] for r in order])


def predict(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of each text; the score is a softmax over the regression outputs."""
    best = np.full(len(column), UNKNOWN, object)
    score = np.zeros(len(column))
    if model.languages:
        letters = pc.match_substring_regex(column, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
        for row, x in blocks(column):
            margins = SHARPNESS * (normed(x) @ model.weights).astype(np.float64)
            odds = np.exp(margins - margins.max(1, keepdims=True))
            odds /= odds.sum(1, keepdims=True)
            first = odds.argmax(1)
            here = slice(row, row + len(x))
            best[here] = np.where(letters[here], np.array(model.languages, object)[first], UNKNOWN)
            score[here] = np.where(letters[here], odds[np.arange(len(x)), first], 0.0)
    return best, score


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    model = fit(docs)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rate(batch: pa.RecordBatch):
        best, score = predict(batch["text"], model)
        return {"doc_id": batch["doc_id"], "lang_pred": best, "score": score}

    scored = docs.select("doc_id", "text").mapInArrow(
        arrow_rows(rate, schema), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
