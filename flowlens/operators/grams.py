"""Gram filter of the pattern scan: candidate positions are found inside the row, before anything is exploded.

Each pattern has an anchor: a run of up to eight bytes, the rarest of the pattern by the byte
pairs of a bounded sample.  A task reads the eight bytes at every position of a text as one
number, tests them against a hashed bitmap of all anchors (its size is a constant, whatever the
number of patterns) and gives only positions that pass.  These are joined with the anchors by their bytes and the
rest of the pattern is compared, so the result never depends on the bitmap or the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

GRAM = 8
BITMAP_BITS = 24
RUN_BYTES = 1 << 20
#: Bytes of a bitmap that travel as one row.
BLOCK = 1 << 16
SAMPLE_ROWS = 2_000
#: Anchor tables within both bounds are broadcast.
BROADCAST_PATTERNS, BROADCAST_BYTES = 200_000, 32 << 20

_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _slots(grams: np.ndarray, size: int) -> np.ndarray:
    """Places of grams of ``size`` bytes in the bitmap."""
    return ((grams ^ np.uint64(size << 56)) * _SPREAD >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; NULL texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pair_counts(df: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """How often each pair of neighbouring bytes occurs in at most ``rows`` texts: 65,536 numbers."""
    sample = df.select(F.col(text_col).alias("t")).limit(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data = _bytes_of(batch["t"])[0].astype(np.int64)
            total += np.bincount(data[:-1] << 8 | data[1:], minlength=1 << 16) if len(data) > 1 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    out = np.zeros(1 << 16)
    for r in sample.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out


def anchors(patterns: DataFrame, pairs: np.ndarray) -> DataFrame:
    """pattern, body (its bytes), size and gram of its anchor, at (the anchor's place), chars and lead (characters of it and before the anchor)."""
    rarity = -np.log((pairs + 1.0) / (pairs.sum() + len(pairs)))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["pattern"].to_pylist():
                body = text.encode("utf-8", "surrogatepass")
                data, at = np.frombuffer(body, np.uint8), 0
                if len(body) > GRAM:
                    rare = np.concatenate([[0.0], np.cumsum(rarity[data[:-1].astype(np.int64) << 8 | data[1:]])])
                    at = int((rare[GRAM - 1 :] - rare[: len(rare) - GRAM + 1]).argmax())
                gram = int.from_bytes(body[at : at + GRAM], "little")
                starts = (data & 0xC0) != 0x80
                rows.append((text, body, min(len(body), GRAM), gram - (1 << 64 if gram >= 1 << 63 else 0), at, int(starts.sum()), int(starts[:at].sum())))
            types = (pa.string(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             names=["pattern", "body", "size", "gram", "at", "chars", "lead"])

    return patterns.select("pattern").mapInArrow(choose, "pattern string, body binary, size int, gram long, at int, chars int, lead int")


def bitmaps(table: DataFrame) -> dict[int, np.ndarray]:
    """For each anchor size the packed bitmap of its anchors: at most eight of 2**BITMAP_BITS bits, put together by tasks."""
    width = 1 << (BITMAP_BITS - 3)
    names = ["size", "block", "bits"]

    def row(size: int, block: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes, grams = batch["size"].to_numpy(), batch["gram"].to_numpy().view(np.uint64)
            for n in np.unique(sizes).tolist():
                slot = _slots(grams[sizes == n], n)
                np.bitwise_or.at(held.setdefault(n, np.zeros(width, np.uint8)), slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        for n, bits in held.items():
            for block, part in enumerate(bits.reshape(-1, BLOCK)):
                if part.any():
                    yield row(n, block, part)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bits = None, None
        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(r["bits"], np.uint8)
                if key == (r["size"], r["block"]):
                    bits = bits | part
                else:
                    if key is not None:
                        yield row(*key, bits)
                    key, bits = (r["size"], r["block"]), part
        if key is not None:
            yield row(*key, bits)

    ddl = "size int, block int, bits binary"
    parts = table.select("size", "gram").mapInArrow(mark, ddl).repartition("size", "block").sortWithinPartitions("size", "block").mapInArrow(merge, ddl)
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        bits = out.setdefault(r["size"], np.zeros(width, np.uint8))
        bits[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["bits"], np.uint8)
    return dict(sorted(out.items()))


def candidates(df: DataFrame, text_col: str, maps: dict[int, np.ndarray], before: int, after: int) -> DataFrame:
    """The other columns of ``df``, size, gram, pos (characters before the anchor), around (bytes: ``before`` ahead of the anchor and ``after`` from it), cut.

    ``cut`` bytes are missing at the front of ``around`` where the text begins later.
    """
    keep = [c for c in df.columns if c != text_col]
    names = [f"__k{i}" for i in range(len(keep))]
    slim = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text_col).alias("__text"))
    sizes = sorted(maps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes_of(batch["__text"])
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            for a in range(0, len(data), RUN_BYTES):
                here = np.concatenate([data[a : a + RUN_BYTES + GRAM], np.zeros(GRAM, np.uint8)])
                n = min(RUN_BYTES, len(data) - a)
                eight = np.ndarray(n, "<u8", here, strides=(1,))
                for size in sizes:
                    grams = eight & _FIRST[size]
                    slot = _slots(grams, size)
                    at = np.flatnonzero(maps[size][slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    row = np.searchsorted(offsets, at + a, "right") - 1
                    inside = at + a + size <= offsets[row + 1]
                    at, row = at[inside], row[inside]
                    if not len(at):
                        continue
                    place = at + a
                    low, high = np.maximum(place - before, offsets[row]), np.minimum(place + max(after, size), offsets[row + 1])
                    around = [None] * len(place) if size < GRAM else [data[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist())]
                    taken = batch.select(names).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([
                        *taken.columns, pa.array(np.full(len(at), size, np.int32)), pa.array(grams[at].view(np.int64)),
                        pa.array(chars[place] - chars[offsets[row]]), pa.array(around, pa.binary()), pa.array(place - low)],
                        names=[*names, "size", "gram", "pos", "around", "front"])

    kinds = dict(slim.dtypes)
    ddl = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "size int", "gram long", "pos long", "around binary", "front long"])
    return slim.mapInArrow(run, ddl).withColumnsRenamed(dict(zip(names, keep)))
