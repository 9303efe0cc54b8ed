"""Phrase collocations from a weighted de Bruijn graph of words.

Every word occurrence starts one edge: from the node (w1, w2) over (w1, w2, w3) to the
node (w2, w3).  Where the piece ends, the missing words are ``END``: these edges are the piece-end
corrections.  So the graph holds every count:

* f(w1 w2 w3) is the weight of an edge,
* f(w1 w2) is the flow out of a node, its edges to ``END`` included,
* f(w1) is the flow out of all nodes that begin with w1, and n the whole flow.

1. Tasks hash the words of whole texts (64 bits of language and word), sum equal edges and
   send them to the partition of their first word, in which edges are sorted once; one pass reads off
   edge weights, node flows and word flows.  Words and pairs that hold much of a bounded
   sample of documents are salted (the sample steers cost, never the result), and what a task or a
   salt has only part of is summed afterwards.
2. Frequent edges form the graph of candidates.  A node with all its flow in one edge in and one
   edge out is unary: its edges are joined to paths by pointer doubling, and the node, whose count
   is the path's weight, is no candidate (the longer phrase holds all its occurrences).  Only
   branching nodes are scored as two-word phrases.
3. Scores are exact: decimal products, whole-number division.

Words are told apart by 64-bit hashes; the vocabulary, gathered in full, is checked: if two
words shared a hash, the job starts again with another seed, so counts are never mixed.

Defined results: a null text is empty, a null language is ``und``; pieces without words count
nothing; repeated rows count each time; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.llm.common import arrow_batches, uniform
from flowlens.session import materialize

LEAST = 10
BEST = 2000
#: A candidate goes when a longer one holds it in at least this many percent of its occurrences.
HELD = 50
#: Words whose edges a task sums at a time.
RUN_WORDS = 1 << 21
#: Rows that the graph task reads at a time.
GRAPH_ROWS = 1 << 20
#: Documents of the sample that names hot words and pairs, and the share of its words that is hot.
SAMPLE_DOCS, HOT_SHARE, SALTS = 10_000, 1 / 500, 64
BATCH_BYTES = "8m"

END = 0
BETWEEN = np.zeros(256, bool)
BETWEEN[[ord(c) for c in ".,;:!?"]] = True
BETWEEN[0x0A:0x0E] = True  # line feed to carriage return
BORDERS = BETWEEN.copy()
BORDERS[[0x20, 0x09]] = True

EDGE_DDL = "h1 long, h2 long, h3 long, salt long, n long"
COUNT_DDL = "words int, h1 long, h2 long, h3 long, n long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _language(name: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}\x00{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def occurrences(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(hash, opens a piece, bytes, starts, ends, languages, language of each word) of runs of whole texts."""
    names = [x if x is not None else "und" for x in batch["lang"].to_pylist()]
    for first, end, data, offsets in wh.chunks(batch["text"]):
        found = wh.words(data, offsets, BORDERS)
        text = np.repeat(np.arange(end - first), np.diff(found.bounds))
        piece = np.cumsum(BETWEEN[data])[found.starts] if len(data) else text
        opens = np.ones(len(text), bool)
        opens[1:] = (text[1:] != text[:-1]) | (piece[1:] != piece[:-1])
        known = {name: _language(name, seed) for name in set(names[first:end])}
        salt = np.array([known[x] for x in names[first:end]], np.uint64)
        hashes = wh.mix(found.hashes ^ salt[text])
        hashes[hashes == END] = 1
        yield hashes, opens, data, found.starts, found.ends, names[first:end], text


def edges_of(hashes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Rows h1, h2, h3, n: the summed edges of a run of words, in ascending order."""
    follows = np.zeros(len(hashes) + 1, bool)
    follows[1:-1] = ~opens[1:]  # follows[i]: word i goes on in the piece of word i - 1
    ahead = np.concatenate([hashes, np.full(2, END, np.uint64)])
    second = np.where(follows[1:], ahead[1:-1], np.uint64(END))
    third = np.where(follows[1:] & np.append(follows[2:], False), ahead[2:], np.uint64(END))
    order = np.lexsort((third, second, hashes))
    rows = np.stack([hashes, second, third])[:, order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
    at = np.flatnonzero(fresh)
    return np.concatenate([rows[:, at], np.diff(np.append(at, len(order))).astype(np.uint64)[None]])


def summed_edges(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[np.ndarray]:
    hashes, opens, n = [], [], 0
    for batch in batches:
        for h, o, *_ in occurrences(batch, seed):
            hashes.append(h), opens.append(o)
            n += len(h)
            if n >= RUN_WORDS:
                yield edges_of(np.concatenate(hashes), np.concatenate(opens))
                hashes, opens, n = [], [], 0
    if n:
        yield edges_of(np.concatenate(hashes), np.concatenate(opens))


def hot_nodes(docs: DataFrame, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, pairs) with more than HOT_SHARE of a bounded sample's edges, as sorted hashes: at most 2 / HOT_SHARE values."""
    total = docs.count()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in summed_edges(batches, seed):
            pairs = wh.ngrams(rows[0] + rows[1] * np.uint64(wh.BASE), (0,))
            whole = rows[3].sum()
            for kind, of in ((0, np.zeros(len(pairs), np.uint64)), (1, rows[0]), (2, pairs)):
                names, at = np.unique(of, return_inverse=True)
                sums = np.bincount(at, rows[3].astype(float))
                use = sums >= HOT_SHARE / 4 * whole
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(use.sum(), kind, np.int32)), _signed(names[use]), pa.array(sums[use].astype(np.int64))],
                    names=["kind", "name", "n"])

    sample = docs if total <= SAMPLE_DOCS else docs.filter(uniform("doc_id", "text", seed=3) < SAMPLE_DOCS / total)
    found = sample.select("lang", "text").mapInArrow(task, "kind int, name long, n long")
    top = found.groupBy("kind", "name").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc()).limit(int(4 / HOT_SHARE)).collect()
    whole = max((r["n"] for r in top if r["kind"] == 0), default=1)  # kind 0: all edges
    return tuple(np.sort(np.array([r["name"] for r in top if r["kind"] == kind and r["n"] > HOT_SHARE * whole], np.int64).view(np.uint64))
                 for kind in (1, 2))


def _held(values: np.ndarray, sorted_names: np.ndarray) -> np.ndarray:
    if not len(sorted_names):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_names, values), len(sorted_names) - 1)
    return sorted_names[at] == values


def edges(docs: DataFrame, seed: int = 0) -> DataFrame:
    """h1, h2, h3, salt, n: edges summed by task.  The salt is above 2**32 for the edges of hot pairs."""
    words, pairs = hot_nodes(docs, seed)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in summed_edges(batches, seed):
            h1, h2, h3, n = rows
            salt = np.where(_held(h1, words), wh.mix(h2) % np.uint64(SALTS) + np.uint64(1), np.uint64(0))
            hot = _held(wh.ngrams(h1 + h2 * np.uint64(wh.BASE), (0,)), pairs)
            salt[hot] = (np.uint64(1) << np.uint64(32)) + wh.mix(h3[hot]) % np.uint64(SALTS)
            for a in range(0, len(h1), GRAPH_ROWS // 4):
                part = slice(a, a + GRAPH_ROWS // 4)
                yield pa.RecordBatch.from_arrays([_signed(x[part]) for x in (h1, h2, h3, salt, n)], names=["h1", "h2", "h3", "salt", "n"])

    return docs.select("lang", "text").mapInArrow(task, EDGE_DDL)


def flows(rows: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, rows h1 h2 h3 n) of sorted edges h1, h2, h3, salt, n: weights and flows of at least ``least``.

    The first and last group may go on outside the run and a salted pair elsewhere:
    these are given whatever their sum.
    """
    names, salt, n = rows[:3], rows[3], rows[4].astype(np.int64)
    for words in (3, 2, 1):
        fresh = np.ones(rows.shape[1], bool)
        fresh[1:] = (names[:words, 1:] != names[:words, :-1]).any(0)
        at = np.flatnonzero(fresh)
        total = np.add.reduceat(n, at)
        use = total >= least
        use[[0, -1]] = True
        if words == 1:
            use[:] = True  # every word counts for n
        if words == 2:
            use |= salt[at] >= 1 << 32
        if words > 1:
            use &= names[words - 1, at] != END
        out = np.zeros((4, int(use.sum())), np.int64)
        out[:words] = names[:words, at[use]]
        out[3] = total[use]
        yield words, out


def counts(found: DataFrame, least: int = LEAST) -> DataFrame:
    """words, h1, h2, h3, n: parts of the counts of phrases of up to three words; sums below ``least`` may be missing for two and three."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def result() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            for words, out in flows(rows, least):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(out.shape[1], words, np.int32)), *(pa.array(x) for x in out)], names=["words", "h1", "h2", "h3", "n"])

        for batch in batches:
            if len(batch) == 0:
                continue
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            size += len(batch)
            if size >= GRAPH_ROWS:
                yield from result()
                held, size = [], 0
        if size:
            yield from result()

    dealt = found.repartition("h1", "salt").sortWithinPartitions("h1", "h2", "h3")
    return dealt.mapInArrow(task, COUNT_DDL)


def vocabulary(docs: DataFrame, seed: int = 0) -> DataFrame:
    """h, lang, word: every word of every language with its hash."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)
        for batch in batches:
            for hashes, _, data, starts, ends, names, text in occurrences(batch, seed):
                fresh, first = np.unique(hashes, return_index=True)
                new = ~_held(fresh, seen)
                fresh, first = fresh[new], first[new]
                seen = np.sort(np.concatenate([seen, fresh])) if len(seen) < RUN_WORDS else fresh
                raw = wh.lowered(data).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [_signed(fresh), pa.array([names[k] for k in text[first].tolist()], pa.string()),
                     pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], pa.binary()).cast(pa.string())],
                    names=["h", "lang", "word"])

    every = docs.select("lang", "text").mapInArrow(task, "h long, lang string, word string")
    return every.distinct()


def paths(heavy: DataFrame) -> DataFrame:
    """h1, h2, h3, n, path_words: the frequent edges, with the words of the unary path that each is compacted to.

    ``heavy`` has the columns h1, h2, h3, n (weight), left and right (flow of the edge's two nodes).  A node is unary if
    an edge in and an edge out both carry its whole flow.  Edges point to the one before; pointers
    double until all are at the head of their path, so a path of m edges takes log2(m) rounds.
    """
    key = ["h1", "h2", "h3"]
    into = heavy.filter(F.col("n") == F.col("right")).select(F.struct(*key).alias("before"), F.col("h2").alias("a"), F.col("h3").alias("b"))
    onto = heavy.filter(F.col("n") == F.col("left")).select(F.struct(*key).alias("edge"), F.col("h1").alias("a"), F.col("h2").alias("b"))
    # one edge in and one out a node: no group to be split
    links = materialize(onto.join(into, ["a", "b"]).select(
        "edge", F.col("before").alias("to"), F.lit(1).cast("long").alias("hops"), F.lit(True).alias("open")), "paths-links")
    while not links.filter("open").isEmpty():
        ahead = links.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        moved = links.filter("open").join(ahead, "to", "left").select(
            "edge", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            F.col("next").isNotNull().alias("open"))
        links = materialize(moved.unionByName(links.filter(~F.col("open"))), "paths-links")
    at_head = links
    length = at_head.groupBy("to").agg((F.max("hops") + 3).alias("path_words"))
    members = at_head.join(length, "to").select("edge", "path_words").unionByName(length.select(F.col("to").alias("edge"), "path_words"))
    return heavy.withColumn("edge", F.struct(*key)).join(members, "edge", "left").select(
        *heavy.columns, F.coalesce("path_words", F.lit(3).cast("long")).alias("path_words"))


def _scored(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """a, l, r, score of the lowest-scoring cut, ties to the first."""
    big = "decimal(38,0)"

    def one(l, r):
        return F.struct(
            F.call_function("div", F.lit(1_000_000).cast("decimal(10,0)") * F.col("a").cast("decimal(14,0)") * F.col("a").cast("decimal(14,0)"),
                            F.col(l).cast("decimal(18,0)") * F.col(r).cast("decimal(18,0)")).cast("long").alias("score"),
            F.col(l).alias("l"), F.col(r).alias("r"))

    best = one(*cuts[0])
    for cut in cuts[1:]:
        now = one(*cut)
        best = F.when(now["score"] < best["score"], now).otherwise(best)
    return rows.withColumn("best", best)


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, path_words: each language's first ``best`` phrases of two and three words."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        seed = 0
        while True:
            words = materialize(vocabulary(docs, seed), "phrase-words")
            if words.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).isEmpty():
                break  # no two words share a hash
            seed += 1
        parts = materialize(counts(edges(docs, seed), least), "phrase-counts")

    def of(k: int, names: list[str]) -> DataFrame:
        return parts.filter(F.col("words") == k).groupBy(*names).agg(F.sum("n").alias("n"))

    single = materialize(of(1, ["h1"]).withColumnRenamed("h1", "h").join(words, "h"), "phrase-single")
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    known = single.filter(F.col("n") >= least)
    pairs = materialize(of(2, ["h1", "h2"]).filter(F.col("n") >= least), "phrase-pairs")
    threes = of(3, ["h1", "h2", "h3"]).filter(F.col("n") >= least)
    left = pairs.select("h1", "h2", F.col("n").alias("left"))
    right = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("n").alias("right"))
    heavy = materialize(threes.join(left, ["h1", "h2"]).join(right, ["h2", "h3"]).select("h1", "h2", "h3", "n", "left", "right"), "phrase-edges")
    compact = paths(heavy)

    # two-word phrases: nodes but those that a longer candidate holds; all unary nodes are among these
    longer = heavy.select("h1", "h2", "n").unionByName(heavy.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "n"))
    most = longer.groupBy("h1", "h2").agg(F.max("n").alias("most"))
    free = pairs.join(most, ["h1", "h2"], "left").filter(
        F.col("most").isNull() | (F.col("most") * 100 < F.col("n") * held)).select("h1", "h2", F.col("n").alias("a"))

    def word(k: int) -> DataFrame:
        return known.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("n").alias(f"f{k}"), *(["lang"] if k == 1 else []))

    two = _scored(free.join(word(1), "h1").join(word(2), "h2"), [("f1", "f2")]).select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "best", F.lit(None).cast("long").alias("path_words"))
    three = _scored(compact.withColumnRenamed("n", "a").join(word(1), "h1").join(word(2).drop("f2"), "h2").join(word(3), "h3"),
                    [("f1", "right"), ("left", "f3")]).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "best", "path_words")
    every = two.unionByName(three).select("lang", "phrase", "a", "best.l", "best.r", "best.score", "path_words")
    # the best of 64 parts of a language first, so that no task ranks all its candidates
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = every.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).filter(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
