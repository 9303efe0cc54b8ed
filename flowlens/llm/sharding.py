"""Sharding by histogram sort: balanced shards of bytes from exact counts, one exchange of rows.

Rows are ordered by (hash of the text, hash of the id), so equal texts are
neighbours and stay in one shard unless a boundary must fall among them.  Bounds of
``shards x pieces`` equal parts of all bytes are searched together: every round
counts the exact bytes in 65,536 ranges of each still open bracket and keeps, for each
bound, the range that holds its target, until an edge of a range is within tolerance.
Where a bracket has shrunk to one text's hash (a large group of equal texts) the
search goes on in the hash of the id, so such a group is split by rows.

Only counts reach the driver, of a bounded number of ranges a round; rows move once,
to their piece, where they are numbered.  A shard's pieces are numbered on.

Defined results: a null text is an empty one for size and checksum but sorts by
itself; null ids and repeated rows are ordinary rows (rows alike in every compared
column are numbered in some order); an empty table gives no rows; extra columns are
ignored by ``assign``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import materialize

SHARDS = 16
ROWS_A_PIECE = 500_000
MOST_PIECES = 64
TOLERANCE = 0.002
DIGIT = 16


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two parts of the order key."""
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64("text").alias("kt"), F.xxhash64(F.lit(1), "doc_id").alias("kd"))


def splitters(rows: DataFrame, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """``parts - 1`` keys; part k holds the rows from key k on, below key k + 1.

    ``tolerance``: accepted distance of a bound from its target, as a share of one part.
    """
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    goals = [total * k / parts for k in range(1, parts)]
    slack = max(tolerance * total / parts, 0.5)
    found: dict[int, tuple[int, int]] = {}
    low = -(1 << 63)
    # bracket -> (bytes below it, the goals inside); a bracket is (text hash or None, first key, digits known)
    brackets = {(None, low, 0): (0, list(range(len(goals))))}
    while brackets:
        following: dict[tuple, tuple[int, list[int]]] = {}
        for bracket, edges in _count(rows, brackets).items():
            below, inside = brackets[bracket]
            for start, size, one_text in edges:
                mine = [g for g in inside if below <= goals[g] < below + size]
                for g in mine:
                    text, at, digits = start
                    near = below if goals[g] - below <= below + size - goals[g] else below + size
                    last = digits >= 64 or (text is None and one_text is None and digits >= 64)
                    if abs(near - goals[g]) <= slack or (last and text is not None):
                        top = near > below
                        found[g] = _after(start) if top else ((text, at) if text is not None else (at, low))
                    else:
                        child = (one_text, low, 0) if text is None and one_text is not None else start
                        following.setdefault(child, (below, []))[1].append(g)
                below += size
        brackets = following
    return [found[g] if g in found else (low, low) for g in range(len(goals))]


def _after(start: tuple) -> tuple[int, int]:
    """The first key after a range."""
    text, at, digits = start
    step = 1 << (64 - digits)
    top = at + step
    if text is None:
        return (top, -(1 << 63)) if top < 1 << 63 else ((1 << 63) - 1, (1 << 63) - 1)
    return (text, top) if top < 1 << 63 else (text + 1, -(1 << 63))


def _count(rows: DataFrame, brackets: dict) -> dict[tuple, list[tuple]]:
    """Exact bytes of the next ranges of each bracket, in key order, with the text's hash where it is the only one."""
    out: dict[tuple, list[tuple]] = {}
    by_depth: dict[tuple, list] = {}
    for text, first, digits in brackets:
        by_depth.setdefault((text is None, digits), []).append((text, first))
    for (in_text, digits), some in by_depth.items():
        column = F.col("kt") if in_text else F.col("kd")
        deeper = min(digits + DIGIT, 64)
        own = rows
        if digits or not in_text:
            inside = [((F.col("kt") == t) if t is not None else F.lit(True))
                      & ((F.shiftright(column, 64 - digits) == (f >> (64 - digits))) if digits else F.lit(True)) for t, f in some]
            own = rows.filter(_any(inside))
        ranged = own.groupBy(
            (F.lit(None).cast("long") if in_text else F.col("kt")).alias("t"), F.shiftright(column, 64 - deeper).alias("r")
        ).agg(F.sum("size").alias("b"), F.min("kt").alias("lo"), F.max("kt").alias("hi"))
        for r in ranged.orderBy("t", "r").collect():  # at most 65,536 ranges of each bracket
            first = r["r"] << (64 - deeper)
            parent = (r["t"], (first >> (64 - digits)) << (64 - digits) if digits else -(1 << 63), digits)
            only = r["lo"] if in_text and r["lo"] == r["hi"] else None
            out.setdefault(parent, []).append(((r["t"], first, deeper), r["b"], only))
    return out


def _any(conditions: list[Column]) -> Column:
    """A balanced disjunction, so that many brackets do not nest deeply."""
    while len(conditions) > 1:
        conditions = [a | b for a, b in zip(conditions[::2], conditions[1::2])] + conditions[len(conditions) & ~1 :]
    return conditions[0]


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = materialize(keys(docs), "shard-keys")
    pieces = max(1, min(MOST_PIECES, -(-rows.count() // (ROWS_A_PIECE * shards))))
    pieces = max(pieces, 4)
    bounds = splitters(rows, shards * pieces, tolerance * pieces)
    key = F.struct("kt", "kd")
    literal = [F.struct(F.lit(a).alias("kt"), F.lit(b).alias("kd")) for a, b in bounds]
    shard = sum(((key >= literal[k * pieces - 1]).cast("int") for k in range(1, shards)), F.lit(0))
    inner = F.array(*[F.array(*literal[s * pieces : (s + 1) * pieces - 1]) for s in range(shards)])
    piece = F.size(F.filter(F.element_at(inner, F.col("shard") + 1), lambda x: x <= key))
    placed = rows.withColumn("shard", shard.cast("int")).withColumn("piece", piece)
    counts = placed.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    offsets = counts.select("shard", "piece", before.alias("before"))
    here = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("kt", "kd", "doc_id")) - 1
    return placed.withColumn("_here", here).join(offsets, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("_here")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
