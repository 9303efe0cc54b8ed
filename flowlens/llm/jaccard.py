"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact verification.

A document's set is the distinct five-word shingles of its whole text (64-bit hashes).
Two sets link when their Jaccard similarity is at least 0.8.  The join is exact:

1. Equal sets become one class with a count; only classes take part from here.
2. Any linking pair shares one of the first ``n - ceil(0.8 n) + 1`` elements of either
   set in any fixed order.  The order puts elements that are frequent in a sample of
   classes last, so common lines and passages hardly ever count (the sample steers
   cost, never the result).  Prefix elements held by one class only fall out; elements
   held by exactly the same classes count once.
3. The classes of an element form tiles.  A large tile is cut into bands of sizes
   within a factor 1/0.8 and bands into cells of at most ``CELL`` classes; only cells of
   the same or neighbouring bands meet.  Inside a tile, the population counts of the
   difference of two bitmaps bound the overlap from above; pairs that may reach 0.8
   connect their classes.
4. Classes so connected (usually one group of near copies) are gathered with their
   sorted arrays in tiles of the same kind and pairs that pass the bitmap bound are
   intersected exactly.  A tile returns each class's root and the number of documents it
   links to, never its pairs.

The hottest elements are counted by partial aggregation and joined (splittable by
AQE); all others have few classes by construction.  Components are found by
alternating star contraction on tables written to the shared folder.

Defined results: null and empty texts have no shingles and are linked with nothing
(their component is their own id); a text with fewer than five words has one shingle;
repeated rows of one document are one class and get equal results; rows with null ids
get a component if a linked document has an id, else null; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.llm.common import arrow_batches
from flowlens.session import materialize

#: The threshold 0.8 as a fraction of integers: link when DEN * shared >= NUM * union.
NUM, DEN = 4, 5
CELL = 1024
#: Elements of the sets of a cell; a longer set has a cell of its own.
CELL_ELEMENTS = 1 << 20
SAMPLE_BITS, HOT_MOST, HOT_LEAST = 4, 65_536, 4
LEAST_WIDTH, MOST_WIDTH = 64, 1 << 15
#: Size of the Arrow batches of texts and sets that a task holds at a time.
BATCH_BYTES = "8m"
#: Up to this many classes with candidates their ids are sent to the scans; beyond, the texts are shuffled.
BROADCAST_ROWS = 2_000_000


def digest(one: np.ndarray) -> int:
    """64-bit identity of a set, as a signed integer; 0 for the empty set."""
    if not len(one):
        return 0
    parts = np.array([wh.mix(one).sum(dtype=np.uint64), np.bitwise_xor.reduce(wh.mix(one ^ np.uint64(wh.BASE))), len(one)], np.uint64)
    return int(wh.ngrams(parts, (0, 1, 2)).view(np.int64)[0])


def bitmap(one: np.ndarray) -> np.ndarray:
    """The set hashed into about n to 2n bits, as 64-bit words."""
    width = 1 << max(len(one) - 1, 0).bit_length()
    width = min(max(width, LEAST_WIDTH), MOST_WIDTH)
    bits = np.zeros(width, np.uint8)
    bits[(one & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def sets_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of every text."""
    for first, _, data, offsets in wh.chunks(column):
        for k, one in enumerate(wh.shingle_sets(wh.words(data, offsets))):
            yield first + k, one


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, cls, n, bitmap and a mark of the row, if any; the set too for one in 2**SAMPLE_BITS classes, once a task."""
    seen: set[int] = set()
    for batch in batches:
        cls, n, maps, sample = [], [], [], []
        for _, one in sets_of(batch["text"]):
            name = digest(one)
            take = name & ((1 << SAMPLE_BITS) - 1) == 0 and len(one) > 0 and name not in seen
            if take:
                seen.add(name)
            cls.append(name), n.append(len(one)), maps.append(bitmap(one).tobytes() if len(one) else None)
            sample.append(one.view(np.int64) if take else None)
        marks = [c for c in batch.schema.names if c not in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), pa.array(cls, pa.int64()), pa.array(n, pa.int64()),
             pa.array(maps, pa.binary()), pa.array(sample, pa.list_(pa.int64())), *(batch[c] for c in marks)],
            names=["doc_id", "cls", "n", "bitmap", "sample", *marks])


SKETCH_DDL = "doc_id long, cls long, n long, bitmap binary, sample array<long>"


def frequent(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles frequent among the sampled classes, ascending, with a level from 1 to 255: bounded by HOT_MOST."""
    sample = members.filter(F.col("sample").isNotNull()).groupBy("cls").agg(F.first("sample").alias("sample"))
    counts = sample.select(F.explode("sample").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    rows = counts.filter(F.col("c") >= HOT_LEAST).orderBy(F.col("c").desc(), "s").limit(HOT_MOST).collect()
    values = np.array([r["s"] for r in rows], np.int64).view(np.uint64)
    levels = np.minimum(255, np.ceil(8 * np.log2(np.array([r["c"] for r in rows], float) + 1))).astype(np.uint64)
    order = np.argsort(values)
    return values[order], levels[order]


def prefix(one: np.ndarray, hot: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first elements of the set in the common order, as order keys (level, then hash)."""
    keys = one >> np.uint64(8)
    if len(hot):
        at = np.searchsorted(hot, one)
        at[at == len(hot)] = 0
        keys = keys | (np.where(hot[at] == one, level[at], np.uint64(0)) << np.uint64(56))
    n = len(one)
    size = n - -(-NUM * n // DEN) + 1
    return np.partition(keys, size - 1)[:size]


def postings_task(hot: np.ndarray, level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, cls, n = [], [], []
            for _, one in sets_of(batch["text"]):
                name = digest(one)
                if len(one) and name not in seen:
                    seen.add(name)
                    keys.append(prefix(one, hot, level)), cls.append(name), n.append(len(one))
            sizes = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).view(np.int64)),
                 pa.array(np.repeat(np.array(cls, np.int64), sizes)), pa.array(np.repeat(np.array(n, np.int64), sizes))],
                names=["key", "cls", "n"])
    return run


def shared_postings(docs: DataFrame, members: DataFrame) -> DataFrame:
    """group, cls, n, size: the classes of every prefix element that at least two classes hold."""
    hot, level = frequent(members)
    every = materialize(docs.select("text").mapInArrow(postings_task(hot, level), "key long, cls long, n long"), "join-postings")
    is_hot = F.shiftrightunsigned("key", 56) > 0
    marks = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("cls")), F.bit_xor(F.xxhash64(F.lit(1), "cls"))]
    names = ["size", "s1", "s2"]
    by_key = Window.partitionBy("key")
    cold = every.filter(~is_hot).repartition("key").dropDuplicates(["key", "cls"]).select(
        "key", "cls", "n", *[m.over(by_key).alias(a) for m, a in zip(marks, names)])
    some = every.filter(is_hot).dropDuplicates(["key", "cls"])
    known = some.groupBy("key").agg(*[m.alias(a) for m, a in zip(marks, names)]).filter(F.col("size") > 1)
    shared = materialize(cold.filter(F.col("size") > 1).unionByName(some.join(known, "key").select(cold.columns)), "join-shared")
    once = shared.groupBy("s1", "s2", "size").agg(F.min("key").alias("key")).select("key")
    return shared.join(once, "key").select(F.col("key").alias("group"), "cls", "n", "size")


def tiles(rows: DataFrame, exact: bool) -> DataFrame:
    """Rows (group, cls, n, size, ...) with tile and cell; rows of large groups once per tile they meet others in.

    Where sets are compared (``exact``), the rows' column ``load`` is the group's number of elements and bounds cells as well.
    """
    fits = F.col("size") <= CELL
    count = F.count(F.lit(1)) / CELL
    if exact:
        fits &= F.col("load") <= CELL_ELEMENTS
        count = F.greatest(count, F.sum("n") / CELL_ELEMENTS)
    small = rows.filter(fits).withColumn("cell", F.lit(0)).withColumn("tile", F.lit("0"))
    large = rows.filter(~fits).withColumn("band", F.floor(F.log("n") / np.log(DEN / NUM)).cast("int"))
    cells = large.groupBy("group", "band").agg(F.ceil(count).cast("int").alias("k"))
    of_group = cells.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("cells"))
    placed = large.join(of_group, "group").withColumn(
        "cell", F.col("band") * 1_000_000 + F.pmod(F.xxhash64("cls"), F.element_at("cells", F.col("band"))).cast("int"))

    def partners(step: int):
        band = F.col("band") + step
        count = F.coalesce(F.try_element_at(F.col("cells"), band), F.lit(0))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda c: band * 1_000_000 + c)) \
            .otherwise(F.array().cast("array<int>"))

    other = F.explode(F.concat(partners(-1), partners(0), partners(1)))
    met = placed.withColumn("other", other).withColumn(
        "tile", F.concat_ws("-", F.least("cell", "other").cast("string"), F.greatest("cell", "other").cast("string")))
    return small.unionByName(met.select(small.columns))


def compare(cls: np.ndarray, n: np.ndarray, cell: np.ndarray, maps: list[np.ndarray], copies: np.ndarray | None = None,
            sets: list[np.ndarray] | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(root class, linked documents) of each member of a tile.

    Without ``sets``, pairs within the bitmap bound connect; with them, pairs whose
    exact overlap reaches the threshold.  Two cells: only pairs across them.  Unless links
    are counted, pairs that are connected already are not compared again.
    """
    count &= sets is not None
    order = np.argsort(n, kind="stable")
    n, cell = n[order], cell[order]
    across = len(np.unique(cell)) > 1
    links = np.zeros(len(n), np.int64)
    label = np.arange(len(n))  # the connected part of each member
    width = np.array([len(maps[k]) for k in order])
    blocks: dict[int, tuple[int, np.ndarray]] = {}
    for w in np.unique(width):
        at = np.flatnonzero(width == w)  # contiguous: the width grows with the size
        blocks[int(w)] = (int(at[0]), np.stack([maps[order[k]] for k in at]))
    if sets is not None:
        own_copies = copies[order]
        sizes = n
        starts = np.concatenate([[0], np.cumsum(sizes)])
        _, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
        mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int32)
    last = np.searchsorted(n, n * DEN // NUM, "right")  # members up to 1/0.8 of the size
    for i in range(len(n)):
        lo, hi = i + 1, int(last[i])
        if hi <= lo:
            continue
        w = int(width[i])
        mine = blocks[w][1][i - blocks[w][0]]
        differ = np.empty(hi - lo, np.int64)
        for v in (w, 2 * w):
            if v not in blocks:
                continue
            first, block = blocks[v]
            a, b = max(lo, first), min(hi, first + len(block))
            if a < b:
                part = block[a - first : b - first]
                if v > w:
                    part = part[:, :w] | part[:, w:]
                differ[a - lo : b - lo] = np.bitwise_count(part ^ mine).sum(1)
        total = n[i] + n[lo:hi]
        # shared <= (total - differ) / 2 and union = total - shared
        possible = (DEN + NUM) * (total - differ) >= 2 * NUM * total
        if across:
            possible &= cell[lo:hi] != cell[i]
        near = np.flatnonzero(possible) + lo
        if not count:
            near = near[label[near] != label[i]]
        if not len(near):
            continue
        if sets is not None:
            mark[codes[starts[i] : starts[i + 1]]] = 1
            run = np.repeat(starts[near] - np.concatenate([[0], np.cumsum(sizes[near])[:-1]]), sizes[near])
            hits = mark[codes[run + np.arange(len(run))]]
            shared = np.add.reduceat(hits, np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            mark[codes[starts[i] : starts[i + 1]]] = 0
            near = near[DEN * shared >= NUM * (n[i] + sizes[near] - shared)]
            links[i] += own_copies[near].sum()
            links[near] += own_copies[i]
        others = np.unique(label[near])
        others = others[others != label[i]]
        if len(others):
            label[np.isin(label, others)] = label[i]
    found = label
    least = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(least, found, cls[order])
    root, linked = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
    root[order], linked[order] = least[found], links
    return root, linked


def tile_task(exact: bool, count: bool):
    """Compares the members of each tile; rows come sorted by (group, tile)."""
    names = ["cls", "root", "links"]

    def result(cls, root, links) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (cls, root, links)], names=names)

    def flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        rows = list({r["cls"]: r for r in rows}.values())
        if len(rows) < 2:
            return
        column = lambda c: np.array([r[c] for r in rows], np.int64)
        cls, n, cell = column("cls"), column("n"), column("cell")
        maps = [np.frombuffer(r["bitmap"], np.uint64) for r in rows]
        if exact:
            sets = [np.frombuffer(r["set"], np.uint64) for r in rows]
            root, links = compare(cls, n, cell, maps, column("copies"), sets, count)
        else:
            root, links = compare(cls, n, cell, maps)
        use = (root != cls) | (links > 0)
        yield result(cls[use], root[use], links[use])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["group"], row["tile"]) != tile:
                    yield from flush(rows)
                    tile, rows = (row["group"], row["tile"]), []
                rows.append(row)
        yield from flush(rows)

    return run


def in_tiles(rows: DataFrame, exact: bool, count: bool = True) -> DataFrame:
    """cls, root, links per member and tile."""
    dealt = tiles(rows, exact).repartition("group", "tile").sortWithinPartitions("group", "tile")
    return dealt.mapInArrow(tile_task(exact, count), "cls long, root long, links long")


def components(edges: DataFrame, label: str) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b)."""
    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())

    e = materialize(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    now = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.withColumnRenamed("m", "v")).filter(F.col("u") != F.col("v")).distinct(), label)
        before, now = now, state(e)
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def sets_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cls and set of the wanted texts, once a task."""
    seen: set[int] = set()
    for batch in batches:
        want, cls, sets = batch["cls"].to_pylist(), [], []
        for row, one in sets_of(batch["text"]):
            if digest(one) == want[row] and want[row] not in seen:
                seen.add(want[row])
                cls.append(want[row]), sets.append(one.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "set"])


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked with, copies included) of every row."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        members, classes, exact, linked = _linked(docs.select("doc_id", "text"), count=True)
        least = linked.join(classes, F.col("node") == F.col("cls")).groupBy("component").agg(F.min("rep").alias("component_id"))
        of_class = linked.join(least, "component").select(F.col("node").alias("cls"), "component_id")
        counts = exact.groupBy("cls").agg(F.sum("links").alias("links"))
        facts = classes.join(of_class, "cls", "left").join(counts, "cls", "left").select(
            "cls", F.coalesce("component_id", "rep").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        return members.select("doc_id", "cls", F.col("n").alias("n_shingles")).join(facts, "cls", "left").select(
            "doc_id", "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def _linked(docs: DataFrame, count: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows with their class, classes, links in tiles, component of each linked class)."""
    columns = [c for c in docs.columns if c not in ("doc_id", "text")]  # a mark of the row, at most
    kept = "".join(f", {c} long" for c in columns)
    members = materialize(docs.select("doc_id", "text", *columns).mapInArrow(sketches, SKETCH_DDL + kept), "join-sketches")
    classes = members.filter(F.col("n") > 0).groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    classes = materialize(classes, "join-classes")

    shared = shared_postings(docs, members).join(classes.select("cls", "bitmap"), "cls")
    possible = in_tiles(shared, exact=False).select(F.col("cls").alias("a"), F.col("root").alias("b"))
    groups = materialize(components(possible, "join-possible").join(classes, F.col("node") == F.col("cls"))
                         .select("cls", "component", "rep", "copies", "n", "bitmap"), "join-groups")

    wanted = groups.select("rep", "cls")
    wanted = F.broadcast(wanted) if groups.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "cls")
    sets = texts.mapInArrow(sets_task, "cls long, set binary")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"))
    sized = groups.join(sizes, "component").withColumnRenamed("component", "group")
    exact = materialize(in_tiles(sized.drop("rep").join(sets, "cls"), exact=True, count=count), "join-links")
    return members, classes, exact, components(exact.select(F.col("cls").alias("a"), F.col("root").alias("b")), "join-components")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the first by doc_id (null last), class and row hash.

    Rows without words are copies of nothing and stay; of rows alike in every column one stays.
    """
    hashed = [f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*hashed).alias("mark"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        members, _, _, linked = _linked(marked.select("row.doc_id", "row.text", "mark"), count=False)
        component = linked.select(F.col("node").alias("cls"), "component")
        rows = members.filter(F.col("n") > 0).select("doc_id", "cls", "mark").join(component, "cls", "left")
        first = rows.groupBy(F.coalesce("component", "cls")).agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls", "mark")).alias("first"))
        kept = materialize(first.select(F.col("first.doc_id").alias("id"), F.col("first.mark").alias("kept")), "join-kept")
        alike = members.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
        repeated = not alike.isEmpty()
    has_words = F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = marked.filter(has_words).join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("kept")), "left_semi")
    if repeated:
        chosen = chosen.withColumn("id", F.col("row.doc_id")).dropDuplicates(["id", "mark"]).drop("id")
    return marked.filter(~has_words).unionByName(chosen).select("row.*")
