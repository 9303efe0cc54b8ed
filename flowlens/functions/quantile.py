"""Exact interpolated quantiles with bounded memory.

``percentile`` and ``median`` keep every distinct value of a group in one
buffer.  Here two scans do for any number of columns: the first builds mergeable
sketches, whose rank error is bounded, and so a bracket around every wanted rank; the
second counts what lies outside the brackets and reads what lies inside.  The sketches are made as fine
as it takes to leave at most ``INSIDE`` values in all brackets together.  A table too large for
the finest sketch, or a rank that its bracket does not hold, goes on with counts in equal-width
buckets, which shrink a bracket some thousandfold per pass.

The wanted columns are written once and every pass reads that table.  NULL, NaN and
infinite values take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.session import materialize

BUCKETS = 4096
SMALL = 10_000
#: Values read from all brackets together, about; the accuracy of the sketches from that, within bounds.
INSIDE = 200_000
LEAST_ACCURACY, MOST_ACCURACY = 10_000, 200_000


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]], small: int = SMALL,
                    buckets: int = BUCKETS) -> dict[tuple[str, float], float | None]:
    """``{(column, probability): value}`` by linear interpolation over the finite values.

    ``small`` decides only when a bracket's values are read instead of narrowed again.
    """
    data = materialize(df.select(*[finite(F.col(c)).alias(c) for c in wanted]), "quantiles")
    first = data.agg(*[F.struct(F.count(c).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                       for c in wanted]).first()
    ranks = {(c, p): p * (first[c]["n"] - 1) for c, ps in wanted.items() for p in ps if first[c]["n"]}
    # One bracket per wanted order statistic: [lo, hi], rows below lo, rows inside.
    open_ = {}
    for (c, _), r in ranks.items():
        for k in (math.floor(r), math.ceil(r)):
            open_[c, k] = (first[c]["lo"], first[c]["hi"], 0, first[c]["n"])
    value = _from_sketches(data, wanted, ranks, {c: first[c] for c in wanted})
    open_ = {k: b for k, b in open_.items() if k not in value}
    while open_:
        for key, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                value[key] = lo
                del open_[key]
        wide = {k: b for k, b in open_.items() if b[3] > small}
        if not wide:
            break
        narrower = _narrow(data, wide, buckets)
        if any(narrower.get(k) in (None, b) for k, b in wide.items()):
            raise RuntimeError(f"quantile brackets do not shrink: {wide}")
        open_.update(narrower)
    value.update(_read(data, open_))

    def at(c: str, r: float) -> float:
        lo, hi = value[c, math.floor(r)], value[c, math.ceil(r)]
        part = r - math.floor(r)
        return lo if part == 0 or lo == hi else lo * (1 - part) + hi * part if math.isinf(hi - lo) else lo + (hi - lo) * part

    return {(c, p): at(c, ranks[c, p]) if (c, p) in ranks else None for c, ps in wanted.items() for p in ps}


def _from_sketches(data: DataFrame, wanted: dict[str, list[float]], ranks: dict, first: dict) -> dict[tuple[str, int], float]:
    """Order statistics found in brackets from sketches; those that are not are left to the caller."""
    n = max((r["n"] for r in first.values()), default=0)
    accuracy = max(LEAST_ACCURACY, 4 * n * len(ranks) // INSIDE)
    if not ranks or accuracy > MOST_ACCURACY:
        return {}
    margin = 2.0 / accuracy
    columns = sorted({c for c, _ in ranks})
    places = {c: sorted({q for d, p in ranks if d == c for q in (max(p - margin, 0.0), min(p + margin, 1.0))}) for c in columns}
    row = data.agg(*[F.percentile_approx(c, places[c], accuracy).alias(c) for c in columns]).first()
    # per column: the brackets' ends, and whether the gap before each is inside a bracket
    ends: dict[str, np.ndarray] = {}
    wide: dict[str, np.ndarray] = {}
    for c in columns:
        at = dict(zip(places[c], row[c]))
        spans = []
        for d, p in ranks:
            if d == c:
                low, high = max(p - margin, 0.0), min(p + margin, 1.0)
                spans.append((first[c]["lo"] if low == 0.0 else at[low], first[c]["hi"] if high == 1.0 else at[high]))
        ends[c] = np.unique(np.array([x for s in spans for x in s], float))
        inside = np.zeros(len(ends[c]) + 1, bool)
        for lo, hi in spans:
            a, b = np.searchsorted(ends[c], [lo, hi])
            inside[a + 1 : b + 1] = True
        wide[c] = inside

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # place 2g: values in gap g (with the value where the gap is in a bracket), 2g + 1: equal to end g
        held: dict[tuple[int, int, float], int] = {}
        for batch in batches:
            for i, c in enumerate(columns):
                x = batch[c].drop_null().to_numpy(zero_copy_only=False)
                gap = np.searchsorted(ends[c], x, "left")
                equal = (gap < len(ends[c])) & (ends[c][np.minimum(gap, len(ends[c]) - 1)] == x)
                place = 2 * gap + equal
                read = ~equal & wide[c][gap]
                for k, m in enumerate(np.bincount(place[~read], minlength=1).tolist()):
                    if m:
                        held[i, k, 0.0] = held.get((i, k, 0.0), 0) + m
                values, m = np.unique(x[read], return_counts=True)
                for v, g, one in zip(values.tolist(), (2 * np.searchsorted(ends[c], values)).tolist(), m.tolist()):
                    held[i, g, v] = held.get((i, g, v), 0) + one
        keys = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.float64()),
             pa.array(list(held.values()), pa.int64())], names=["i", "place", "x", "n"])

    found = data.select(*columns).mapInArrow(count, "i int, place long, x double, n long").groupBy("i", "place", "x").agg(
        F.sum("n").alias("n")).collect()  # the brackets' values and a few counts
    out: dict[tuple[str, int], float] = {}
    for i, c in enumerate(columns):
        rows = sorted((r["place"], r["x"], r["n"]) for r in found if r["i"] == i)
        upto = np.cumsum([m for *_, m in rows])
        for k in {j for d, p in ranks if d == c for j in (math.floor(ranks[d, p]), math.ceil(ranks[d, p]))}:
            at = int(np.searchsorted(upto, k, "right"))
            if at >= len(rows):
                continue
            place, x, _ = rows[at]
            if place % 2:
                out[c, k] = float(ends[c][place // 2])
            elif wide[c][place // 2]:
                out[c, k] = x
    return out


def finite(c: Column) -> Column:
    """The value as a double, NULL where it is not a finite number."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(math.inf)), x)


def _bucket(c: Column, lo: float, hi: float, buckets: int) -> Column:
    """Number of the equal-width bucket; halves first, so that no difference overflows."""
    width = hi / 2 - lo / 2
    if width == 0:  # next to each other
        return F.when(c >= F.lit(hi), F.lit(buckets - 1)).otherwise(0)
    share = (c / 2 - F.lit(lo / 2)) / F.lit(width)
    return F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int"))


def _brackets(open_: dict) -> list[tuple[str, float, float]]:
    return sorted({(c, b[0], b[1]) for (c, _), b in open_.items()})


def _inside(c: str, lo: float, hi: float):
    return F.col(c).between(F.lit(lo), F.lit(hi))


def _narrow(data: DataFrame, wide: dict, buckets: int) -> dict:
    """Bucket counts of every bracket in one job; returns the smaller brackets."""
    spans = _brackets(wide)
    entries = []
    for i, (c, lo, hi) in enumerate(spans):
        b = _bucket(F.col(c), lo, hi, buckets)
        entries.append(F.when(_inside(c, lo, hi), F.struct(F.lit(i).alias("i"), b.alias("b"), F.col(c).alias("x"))))
    rows = (
        data.filter(reduce(lambda a, b: a | b, [_inside(*s) for s in spans]))
        .select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .orderBy("i", "b").collect()  # at most buckets rows per bracket
    )
    out = {}
    for (c, k), (lo, hi, below, _) in wide.items():
        i = spans.index((c, lo, hi))
        for r in rows:
            if r["i"] != i:
                continue
            if below + r["n"] > k:
                out[c, k] = (r["lo"], r["hi"], below, r["n"])
                break
            below += r["n"]
    return out


def _read(data: DataFrame, open_: dict) -> dict[tuple[str, int], float]:
    """Order statistics of the remaining small brackets from value counts."""
    spans = _brackets(open_)
    if not spans:
        return {}
    entries = [F.when(_inside(c, lo, hi), F.struct(F.lit(i).alias("i"), F.col(c).alias("x")))
               for i, (c, lo, hi) in enumerate(spans)]
    rows = (
        data.filter(reduce(lambda a, b: a | b, [_inside(*s) for s in spans]))
        .select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("i", "x").agg(F.count(F.lit(1)).alias("n")).orderBy("i", "x").collect()  # checked small
    )
    out = {}
    for (c, k), (lo, hi, below, _) in open_.items():
        i = spans.index((c, lo, hi))
        for r in rows:
            if r["i"] != i:
                continue
            if below + r["n"] > k:
                out[c, k] = r["x"]
                break
            below += r["n"]
    return out
