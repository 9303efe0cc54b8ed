"""Benchmark decontamination: BM25 index of the test items, block-max WAND, overlap check.

The test items are the indexed side, the training passages the queries.  Items are indexed
by length class (a factor ``CLASS`` each).  A passage is a window of ``2 x L`` words, moved by
``L`` words, where L is the longest item of the class, so an item quoted in full always lies
inside one passage and a long item makes no other's passage long.  An item's BM25 impacts are
divided by its score against itself: a passage scores 1.0 for an item whose every word it has.
Word frequencies and the mean length are those of the whole benchmark.

Retrieval is exact, block-max WAND for a batch of passages at a time.  The term maxima of the
distinct words of its two halves bound a passage's score.  A passage above the threshold has its
words ordered by their maxima; the pivot is the first at which their sum reaches the threshold, and an item
without any word from the pivot on cannot reach it.  So only postings blocks of words from the
pivot on are opened; in each block found, the other words are looked up by binary search,
skipping all their other blocks, and their block maxima complete the bound.  Items of blocks that
stay above are scored in full.  Memory follows the blocks opened, ``OPENED`` at a time, not items times
passages.  All items at or above the threshold are kept, then verified: the
passage must hold ``overlap`` of the question's distinct five-word shingles and of
the answer's distinct words.  The answer is column ``answer`` where the benchmark
has one (the question is then ``question``, or the text), else the last quarter
of the item's words, at least ``SHINGLE`` of them.

The index is sent to the tasks in parts of at most ``PART_ITEMS`` items and
``PART_BYTES`` of text, so its size is bounded; a benchmark beyond one part makes
one more pass over the documents per part, one part in the driver at a time.  Nothing is
shuffled but the matches.

Items and texts are compared after full case folding and NFC, so a quote in capitals or
with decomposed accents is the same words.  Every character of a script written without spaces
(Chinese, Japanese, Thai, Lao, Tibetan, Burmese, Khmer and others) is one word, and
punctuation and spaces beyond ASCII separate words as ASCII ones do.

Items of fewer than five words have no shingle to quote.  They match where their exact
word sequence is a unit of its own, between ends of the text, line breaks, sentence ends,
quotation marks or brackets; a given question and answer are looked for in the unit and as many
words on either side of it as the longest item has.  Such a match has score 1.0.

Defined results: null and empty texts match nothing; null items and items
without a word are left out; items with equal texts are reported each; a document repeated as a row is
reported once per (doc_id, item_id); a document with a null id is never reported as
a match, but ``contaminated`` still drops it by its own text; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.session import materialize

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.8
BLOCK = 4
#: Items up to this many words are one class, up to its square the next, and so on.
CLASS = 64
#: Postings blocks opened, or looked up, at a time.
OPENED = 1 << 19
#: Words before the pivot that are looked up in a block before its bound is tried again.
AT_ONCE = 4
PART_ITEMS, PART_BYTES = 50_000, 32 << 20

#: Characters of scripts written without spaces; each is a word.
UNSPACED = re.compile(
    "[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u1b00-\u1b7f\u2e80-\u2fdf\u3005-\u3007"
    "\u3021-\u3029\u3031-\u3035\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua980-\uaadf"
    "\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
#: Spaces, hyphens, apostrophes and commas beyond ASCII, and the marks there that end a unit.
GAP = re.compile("[\u00a0\u00ad\u2000-\u2019\u202a-\u202f\u205f-\u206f\u3000\u3001\ufeff\uff0c]")
MARK = re.compile("[\u00a1\u00ab\u00bb\u00bf\u0e2f\u0e5a\u0e5b\u0f0b-\u0f14\u104a\u104b\u17d4-\u17d6\u201a-\u2029\u2030-\u205e"
                  "\u3002\u3003\u3008-\u301f\uff01-\uff0b\uff0d-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
#: ASCII bytes that end a unit, in which a short item has to stand alone.
ENDS = np.isin(np.arange(256), list(b'\n\r.!?;:"()[]{}<>|'))


@dataclass(frozen=True)
class Index:
    """Postings of one length class by ascending term hash and item, term and block maxima, and what the verification needs."""

    item_ids: np.ndarray
    terms: np.ndarray
    term_max: np.ndarray
    posting_bounds: np.ndarray
    posting_item: np.ndarray
    posting_impact: np.ndarray
    #: Blocks by (term, block of items): the term's runs, the key term x blocks + block, the first posting and the maximum.
    block_bounds: np.ndarray
    block_key: np.ndarray
    block_first: np.ndarray
    block_max: np.ndarray
    #: Word sequences of the items of fewer than five words: sorted hashes, and the item of each.
    short: np.ndarray
    short_item: np.ndarray
    questions: list[np.ndarray]
    #: Words in a shingle of each item's question.
    sizes: list[int]
    answers: list[np.ndarray]
    longest: int
    #: Words on either side of a short item in which its question and answer are looked for.
    reach: int

    @property
    def blocks(self) -> int:
        return -(-len(self.item_ids) // BLOCK)


@dataclass(frozen=True)
class Statistics:
    """Of the whole benchmark: items of five words or more, their mean length, sorted terms and the number of items with each."""

    items: int
    mean: float
    terms: np.ndarray
    counts: np.ndarray
    longest: int


def fold(text: str | None) -> str:
    """The text as it is compared: case folded for all letters, NFC, unspaced scripts as single characters."""
    if not text or text.isascii():
        return (text or "").lower()
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return UNSPACED.sub(r" \g<0> ", MARK.sub(".", GAP.sub(" ", text)))


def folded(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole folded texts."""
    for row, end, _, _ in wh.chunks(column):
        texts = column.slice(row, end - row).to_pylist()
        yield row, *wh.text_bytes(pa.array([fold(t) for t in texts], pa.large_string()))


def hashes(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each folded text; words are runs of ASCII letters and digits and non-ASCII bytes."""
    out = []
    for _, data, offsets in folded(pa.array(texts, pa.large_string())):
        found = wh.words(data, offsets, wh.NOT_ALNUM)
        out += [found.hashes[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:])]
    return out


def shingles(words: np.ndarray, size: int = wh.SHINGLE) -> np.ndarray:
    """Distinct shingles of ``size`` words; of fewer words, the whole sequence."""
    return np.unique(wh.ngrams(words, tuple(range(min(size, len(words))))))


def statistics(texts: list[np.ndarray]) -> Statistics:
    """Statistics of items given as word hashes."""
    long = [w for w in texts if len(w) >= wh.SHINGLE]
    terms, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, long)]), return_counts=True)
    return Statistics(len(long), float(np.mean([len(w) for w in long])) if long else 1.0, terms, counts, max(map(len, texts), default=0))


def build(items: list[tuple[int, str, str | None, str | None]], of: Statistics | None = None) -> Index:
    """Index of (item id, text, question, answer) rows; ``of`` are the statistics of all items, by default of these."""
    texts = hashes([t for _, t, _, _ in items])
    keep = [k for k, w in enumerate(texts) if len(w)]
    items, texts = [items[k] for k in keep], [texts[k] for k in keep]
    of = of or statistics(texts)
    n = len(items)
    questions, sizes, answers = [], [], []
    asked = hashes([q or t for _, t, q, _ in items])
    told = hashes([a or "" for *_, a in items])
    for words, q, a in zip(texts, asked, told):
        if not len(a):
            cut = max(len(words) - max(len(words) // 4, wh.SHINGLE), 0)
            a = words[cut:]
            q = words[:cut] if cut >= wh.SHINGLE else words
        q = q if len(q) else words
        questions.append(shingles(q))
        sizes.append(min(wh.SHINGLE, len(q)))
        answers.append(np.unique(a))
    few = np.array([k for k, w in enumerate(texts) if len(w) < wh.SHINGLE], int)
    short = np.array([wh.ngrams(texts[k], tuple(range(len(texts[k]))))[0] for k in few], np.uint64)
    by_hash = np.argsort(short, kind="stable")
    pairs = [np.unique(w if len(w) >= wh.SHINGLE else w[:0], return_counts=True) for w in texts]
    lengths = np.array([len(w) for w in texts], float)
    term = np.concatenate([t for t, _ in pairs]) if n else np.zeros(0, np.uint64)
    count = np.concatenate([c for _, c in pairs]).astype(float) if n else np.zeros(0)
    item = np.repeat(np.arange(n), [len(t) for t, _ in pairs])
    terms, at = np.unique(term, return_inverse=True)
    df = of.counts[np.searchsorted(of.terms, terms)] if len(terms) else np.zeros(0)
    idf = np.log1p((of.items - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * lengths / max(of.mean, 1.0))
    impact = idf[at] * count * (K1 + 1) / (count + norm[item])
    impact /= np.bincount(item, impact, minlength=n)[item]
    order = np.lexsort((item, at))
    at, item, impact = at[order], item[order], impact[order]
    bounds = np.searchsorted(at, np.arange(len(terms) + 1))
    key = at * -(-n // BLOCK) + item // BLOCK
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(at) else np.zeros(0, int)
    return Index(
        np.array([i for i, *_ in items], np.int64), terms,
        np.maximum.reduceat(impact, bounds[:-1]) if len(at) else np.zeros(0), bounds, item, impact,
        np.searchsorted(at[first], np.arange(len(terms) + 1)), key[first], np.append(first, len(at)),
        np.maximum.reduceat(impact, first) if len(at) else np.zeros(0),
        short[by_hash], few[by_hash], questions, sizes, answers, int(lengths.max()) if n else 0, of.longest)


def spread(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs ``which`` of ``bounds``, and for each the place of its run in ``which``."""
    size = bounds[which + 1] - bounds[which]
    owner = np.repeat(np.arange(len(which)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + bounds[which][owner], owner


def held(index: Index, item: int, words: np.ndarray) -> tuple[float, float]:
    """Shares of an item's question shingles and answer words that a passage holds."""
    return (float(np.isin(index.questions[item], shingles(words, index.sizes[item])).mean()),
            float(np.isin(index.answers[item], words).mean()))


def units(data: np.ndarray, found: wh.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the word runs between ends of texts and of units."""
    ends = np.concatenate([[0], np.cumsum(ENDS[data])])
    new = np.ones(len(found.hashes) + 1, bool)
    new[1:-1] = ends[found.starts[1:]] > ends[found.ends[:-1]]
    new[found.bounds] = True
    at = np.flatnonzero(new)
    return at[:-1], at[1:]


def search_short(row: int, data: np.ndarray, found: wh.Words, index: Index, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """Like ``search``, the short items that are a unit of one of the texts."""
    first, end = units(data, found)
    for size in range(1, wh.SHINGLE):
        start = first[end - first == size]
        if not len(start):
            continue
        grams = wh.ngrams(found.hashes, tuple(range(size)))[start]
        low, high = np.searchsorted(index.short, grams), np.searchsorted(index.short, grams, "right")
        for k in np.flatnonzero(high > low):
            own = int(np.searchsorted(found.bounds, start[k], "right")) - 1
            words = found.hashes[max(start[k] - index.reach, found.bounds[own]) : min(start[k] + size + index.reach, found.bounds[own + 1])]
            for item in index.short_item[low[k] : high[k]]:
                q, a = held(index, item, words)
                if q >= overlap - 1e-9 and a >= overlap - 1e-9:
                    yield row + own, int(item), 1.0, q, a


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive runs whose sizes add up to about ``most``; at least one element each."""
    upto, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of the values of each."""
    names, at = np.unique(key, return_inverse=True)
    return names, np.bincount(at, value, minlength=len(names))


def lookup(index: Index, term: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Number of the postings block of each (term, block), -1 where the term has none there."""
    key = term * index.blocks + block
    at = np.minimum(np.searchsorted(index.block_key, key), len(index.block_key) - 1)
    return np.where(index.block_key[at] == key, at, -1)


def retrieve(index: Index, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, score) of all items at or above the threshold; the distinct terms of each window come in runs."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(window):
        return none
    order = np.lexsort((index.term_max[term], window))
    window, term = window[order], term[order]
    low = threshold - 1e-9
    runs = np.flatnonzero(np.r_[True, window[1:] != window[:-1], True])
    upto = np.cumsum(index.term_max[term])
    run = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
    before = np.r_[0.0, upto][runs[:-1]]
    essential = upto - before[run] >= low  # from the pivot on
    # 1. open the blocks of the words from the pivot on
    opened, of = spread(index.block_bounds, term[essential])
    pair, bound = summed(run[essential][of] * index.blocks + index.block_key[opened] % index.blocks, index.block_max[opened])
    own, block = pair // index.blocks, pair % index.blocks
    rest = np.bincount(run, np.where(essential, 0.0, index.term_max[term]), minlength=len(runs) - 1)
    keep = bound + rest[own] >= low
    own, block, bound = own[keep], block[keep], bound[keep]
    # 2. look the other words up in these blocks, those of large maxima first, while the bound holds
    pivots = np.bincount(run, ~essential, minlength=len(runs) - 1).astype(int)  # words before the pivot, first in their run
    mass = np.r_[0.0, upto]
    found = []
    for part in slices(np.minimum(pivots[own], AT_ONCE) + 1, OPENED):
        o, b, whole, left = own[part], block[part], bound[part], pivots[own[part]]
        while left.any():
            size = np.minimum(left, AT_ONCE)
            left = left - size
            where = np.repeat(np.arange(len(o)), size)
            word = (runs[:-1][o] + left)[where] + np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
            at = lookup(index, term[word], b[where])
            whole = whole + np.bincount(where, np.where(at >= 0, index.block_max[at], 0.0), minlength=len(o))
            rest = mass[runs[:-1][o] + left] - mass[runs[:-1][o]]
            keep = whole + rest >= low
            o, b, whole, left = o[keep], b[keep], whole[keep], left[keep]
        o, b = o[whole >= low], b[whole >= low]
        # 3. score the items of blocks that are still above
        size = np.diff(runs)[o]
        where = np.repeat(np.arange(len(o)), size)
        word = runs[:-1][o][where] + np.arange(len(where)) - np.repeat(np.cumsum(size) - size, size)
        at = lookup(index, term[word], b[where])
        where, at = where[at >= 0], at[at >= 0]
        posting, of = spread(index.block_first, at)
        key, score = summed(o[where][of] * len(index.item_ids) + index.posting_item[posting], index.posting_impact[posting])
        key, score = key[score >= low], score[score >= low]
        found.append((window[runs[:-1]][key // len(index.item_ids)], key % len(index.item_ids), score))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else none


def passages(index: Index, found: wh.Words, threshold: float) -> Iterator[tuple[int, int, float, np.ndarray]]:
    """(text, item, score, words of the passage) of everything retrieved from the texts of a chunk."""
    at = np.searchsorted(index.terms, found.hashes)
    at[at == len(index.terms)] = 0
    known = index.terms[at] == found.hashes
    n_words = np.diff(found.bounds)
    n_cells = np.maximum(1, -(-n_words // index.longest))
    first_cell = np.cumsum(n_cells) - n_cells
    of = np.repeat(np.arange(len(n_words)), n_words)
    cell = first_cell[of] + (np.arange(len(of)) - found.bounds[:-1][of]) // index.longest
    pair = np.unique(cell[known] * len(index.terms) + at[known])
    in_cell, term = pair // len(index.terms), pair % len(index.terms)
    mass = np.bincount(in_cell, index.term_max[term], minlength=n_cells.sum() + 1)
    n_windows = np.maximum(1, n_cells - 1)
    owner = np.repeat(np.arange(len(n_words)), n_windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    left = first_cell[owner] + number
    two = n_cells[owner] > 1
    open_ = np.flatnonzero(mass[left] + np.where(two, mass[left + 1], 0.0) >= threshold - 1e-9)
    if not len(open_):
        return
    start = found.bounds[owner] + number * index.longest
    end = np.minimum(start + 2 * index.longest, found.bounds[owner + 1])
    cells = np.searchsorted(in_cell, np.arange(n_cells.sum() + 2))
    postings = np.r_[0, np.cumsum(np.diff(index.block_bounds)[term])]
    last = left[open_] + two[open_]  # the last of a window's one or two cells
    sizes = postings[cells[last + 1]] - postings[cells[left[open_]]]
    for part in slices(sizes, OPENED):
        chosen = open_[part]
        size = cells[last[part] + 1] - cells[left[chosen]]
        which = np.repeat(np.arange(len(chosen)), size)
        place = np.repeat(cells[left[chosen]] - (np.cumsum(size) - size), size) + np.arange(len(which))
        distinct = np.unique(which * len(index.terms) + term[place])
        for w, item, score in zip(*retrieve(index, distinct // len(index.terms), distinct % len(index.terms), threshold)):
            k = chosen[w]
            yield int(owner[k]), int(item), float(score), found.hashes[start[k] : end[k]]


def search(column: pa.Array, index: Index | list[Index], threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item number, score, question overlap, answer overlap) of each verified passage match; items of several indexes are numbered on."""
    indexes = [index] if isinstance(index, Index) else index
    numbers = np.cumsum([0, *(len(x.item_ids) for x in indexes)]).tolist()
    if not numbers[-1]:
        return
    for row, data, offsets in folded(column):
        found = wh.words(data, offsets, wh.NOT_ALNUM)
        if not len(found.hashes):
            continue
        for one, base in zip(indexes, numbers):
            if len(one.short):
                for own, item, *facts in search_short(row, data, found, one, overlap):
                    yield own, base + item, *facts
            if len(one.terms):
                for own, item, score, words in passages(one, found, threshold):
                    q, a = held(one, item, words)
                    if q >= overlap - 1e-9 and a >= overlap - 1e-9:
                        yield row + own, base + item, score, q, a


def length_class(words: int) -> int:
    """0 up to CLASS words, 1 up to its square, and so on."""
    return 0 if words <= CLASS else int(np.ceil(np.log(words) / np.log(CLASS) - 1e-9)) - 1


def classes(items: list[tuple[int, str, str | None, str | None]], of: Statistics | None = None) -> list[Index]:
    """One index per length class of the items."""
    texts = hashes([t for _, t, _, _ in items])
    of = of or statistics(texts)
    own: dict[int, list] = {}
    for one, words in zip(items, texts):
        if len(words):
            own.setdefault(length_class(len(words)), []).append(one)
    return [build(own[k], of) for k in sorted(own)]


def _counted(rows: DataFrame) -> tuple[DataFrame, int, float, int]:
    """(term, n) of the items of five words or more, their number and mean length, and the longest item: counted by tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashes([t or "" for t in batch["text"].to_pylist()])
            found = statistics(texts)
            words = sum(len(w) for w in texts if len(w) >= wh.SHINGLE)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[found.terms.view(np.int64), 0]), pa.array(np.r_[found.counts, found.items]),
                pa.array(np.r_[np.zeros(len(found.terms), np.int64), words]), pa.array(np.r_[np.zeros(len(found.terms), np.int64), found.longest]),
                pa.array(np.r_[np.ones(len(found.terms), bool), False])], names=["term", "n", "words", "longest", "is_term"])

    found = rows.select("text").mapInArrow(task, "term long, n long, words long, longest long, is_term boolean")
    counts = materialize(found.groupBy("term", "is_term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest")), "benchmark-terms")
    total = counts.filter(~F.col("is_term")).first()
    return counts.filter("is_term").select("term", "n"), total["n"], total["words"] / max(total["n"], 1) or 1.0, total["longest"]


def parts(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Indexes of bounded size that cover the whole benchmark, one part after another; scores do not depend on the parts."""
    text = F.col("text")
    question = F.col("question") if "question" in benchmark.columns else F.lit(None).cast("string")
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.filter(text.isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long"), text, question.alias("q"), answer.alias("a"))
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n_parts = max(1, -(-size["n"] // PART_ITEMS), -(-(size["b"] or 0) // PART_BYTES))
    if n_parts > 1:
        counts, items, mean, longest = _counted(rows)
    for k in range(n_parts):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k)
        items_of = sorted((tuple(r) for r in own.collect()), key=lambda r: (r[0], r[1]))  # at most a part's bound
        of = None
        if n_parts > 1:
            terms = statistics(hashes([t for _, t, _, _ in items_of])).terms
            wanted = benchmark.sparkSession.createDataFrame(pd.DataFrame({"term": terms.view(np.int64)}), "term long")
            found = sorted((np.uint64(r["term"] & (2**64 - 1)), r["n"]) for r in counts.join(wanted, "term").collect())
            of = Statistics(items, mean, np.array([t for t, _ in found], np.uint64), np.array([n for _, n in found]), longest)
        yield classes(items_of, of)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the best passage of each matching pair."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                        ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])

    def task(index: list[Index]):
        item_ids = np.concatenate([np.zeros(0, np.int64), *(x.item_ids for x in index)])

        def run(batches):
            for batch in batches:
                ids, best = batch["doc_id"], {}
                for row, item, *facts in search(batch["text"], index, threshold, overlap):
                    best[row, item] = max(best.get((row, item), (0.0, 0.0, 0.0)), tuple(facts))
                columns = [[ids[row].as_py() for row, _ in best], [int(item_ids[i]) for _, i in best],
                           *([v[c] for v in best.values()] for c in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        return run

    ddl = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found, last = [], None
    for index in parts(benchmark):
        if last is not None:
            found.append(materialize(last, "benchmark-matches"))  # before the next part is built
        last = docs.select("doc_id", "text").mapInArrow(task(index), ddl)
    every = reduce(DataFrame.unionAll, [*found, last]).filter(F.col("doc_id").isNotNull())
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("b")
    return every.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows whose text matches no item, decided row by row in the scan itself."""
    for index in parts(benchmark):
        def run(batches, index=index):
            for batch in batches:
                hit = {row for row, *_ in search(batch["text"], index, threshold, overlap)}
                yield batch.filter(pa.array([k not in hit for k in range(batch.num_rows)], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
