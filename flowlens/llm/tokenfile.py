"""Token-ID output: Arrow files of fixed-size-list batches, open to zero-copy random access.

Texts are range-partitioned and sorted by doc_id once.  Every task encodes whole
texts, appends the end id, packs the stream into sequences of equal length and writes
one Arrow IPC file with two columns: ``ids`` (fixed-size lists of the narrowest
unsigned type that holds the vocabulary) and ``mask`` (fixed-size lists of booleans,
false on the padding of the last sequence).  A file is uncompressed, so a reader maps it
and takes any sequence or token range without reading the rest.

The rows of each document (file, offset, length) are what the task returns; Spark
commits them as a table.  Only files named there count: a task that is run again writes
another file under a new name, so lost executors and second attempts do no harm.

A text is encoded by the tokenizers library piece by piece: its normalisers and its
pre-tokeniser never look across ASCII white space, nor from an ASCII letter to ASCII
punctuation or a digit (``APART``), and fold the case of A-Z.  So the ids of a text are
those of its pieces, and each distinct piece of a worker is encoded once.  Pieces are told
apart by 64-bit hashes.  Texts that hold ``<|``, the start of a special token, are encoded
whole.  ``WordEncoder.follows`` checks a tokenizer against these rules; one that does
not follow them encodes every text whole.

Defined results: null and empty texts are the end id alone; null ids come first;
repeated rows are each written; rows of one doc_id are ordered by text; an empty table
gives no rows and no files; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import wordhash as wh
from flowlens.llm.common import arrow_batches
from flowlens.session import materialize, new_path

SEQUENCE = 2048
BATCH_SEQUENCES = 256
END_ID = 1
CACHED_PIECES = 1_000_000
CHUNK = 1 << 20
PIECES_AT_ONCE = 4_000
#: Size of the Arrow batches of texts that a task holds at a time.
BATCH_BYTES = "8m"

INDEX_DDL = "part int, file string, doc_id long, offset long, n_tokens long"


SPACE, LETTER, DIGIT, MARK, QUOTE, WIDE = range(6)
#: The class of each byte; bytes beyond ASCII are WIDE.
KIND = np.array([WIDE if b > 127 else SPACE if wh.SPACE[b] else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit()
                 else QUOTE if b == 39 else MARK for b in range(256)], np.uint8)
#: APART[a, b]: a piece ends between neighbouring bytes of these classes.
APART = np.zeros((6, 6), bool)
for _a, _b in ((LETTER, MARK), (LETTER, QUOTE), (LETTER, DIGIT), (DIGIT, LETTER), (DIGIT, DIGIT), (DIGIT, MARK), (DIGIT, QUOTE),
               (MARK, LETTER), (MARK, DIGIT), (QUOTE, DIGIT)):
    APART[_a, _b] = True
#: Texts that tell whether a tokenizer works piece by piece.
PROBES = ("It's THE 12th, don't: a1b2 x-y (z) \u00c9t\u00e9, rock'n'roll 'll,'s ''s", "e\u0301, <\u0338 ~~%%% a=b; C++ $9.99 'S\t\n we'RE")
SPECIAL = "<|"


def pieces(data: np.ndarray, offsets: np.ndarray) -> wh.Words:
    """The spans that are encoded on their own; ``hashes[bounds[i]:bounds[i + 1]]`` belong to text i."""
    kind = KIND[data]
    inside = kind != SPACE
    cut = np.ones(len(data) + 1, bool)  # cut[k]: no piece holds both byte k - 1 and byte k
    cut[1:-1] = APART[kind[:-1], kind[1:]] | ~inside[:-1] | ~inside[1:]
    cut[offsets] = True
    starts, ends = np.flatnonzero(inside & cut[:-1]), np.flatnonzero(inside & cut[1:]) + 1
    if len(starts) == 0:
        return wh.Words(np.zeros(0, np.uint64), starts, ends, np.zeros(len(offsets), np.int64))
    return wh.Words(wh.span_hashes(wh.lowered(data), starts, ends), starts, ends, np.searchsorted(starts, offsets))


class WordEncoder:
    """Ids of whole texts, each distinct piece encoded once and kept up to a bound.

    Known pieces are a sorted array of hashes beside the place of their ids, some 40
    bytes a piece.  A Python worker keeps its encoder for its next tasks.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()
        self.by_pieces = self.follows(PROBES)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds = np.zeros(1, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def follows(self, texts) -> bool:
        """Whether the texts' ids are those of their pieces."""
        self.by_pieces = True
        data, offsets = wh.text_bytes(pa.array(texts, pa.large_string()))
        ids, bounds = self._by_pieces(data, offsets, END_ID)
        return all(ids[a : b - 1].tolist() == whole for a, b, whole in zip(bounds[:-1], bounds[1:], self._whole(texts)))

    def _whole(self, texts) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add pieces not known yet, given in ascending order of their hashes."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist())]
        ids, bounds = [self.ids], [self.bounds]
        for n in range(0, len(texts), PIECES_AT_ONCE):
            lists = self._whole(texts[n : n + PIECES_AT_ONCE])
            ids.append(np.fromiter(chain.from_iterable(lists), self.dtype))
            bounds.append(bounds[-1][-1] + np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
        slots = np.arange(len(keys)) + len(self.bounds) - 1
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.ids, self.bounds = np.concatenate(ids), np.concatenate(bounds)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text), with the end id after each."""
        raw = data.tobytes()
        whole = np.ones(len(offsets) - 1, bool)
        if self.by_pieces:
            whole[:] = False
            at = raw.find(SPECIAL.encode())
            while at >= 0:
                k = int(np.searchsorted(offsets, at, "right")) - 1
                whole[k] = True
                at = raw.find(SPECIAL.encode(), int(offsets[k + 1]))
        if not whole.any():
            return self._by_pieces(data, offsets, end_id)
        parts = []
        for k in range(len(whole)):
            a, b = int(offsets[k]), int(offsets[k + 1])
            if whole[k]:
                parts.append(np.array([*self._whole([raw[a:b].decode("utf-8")])[0], end_id], self.dtype))
            else:
                parts.append(self._by_pieces(data[a:b], offsets[k : k + 2] - a, end_id)[0])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        found = pieces(data, offsets)
        distinct, first, inverse = np.unique(found.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_PIECES:
            self._clear()
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        unseen = self.keys[at] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if unseen.any():
            where = first[unseen]
            self._learn(data, distinct[unseen], found.starts[where], found.ends[where])
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][inverse] if len(distinct) else np.zeros(0, np.int64)
        size = self.bounds[slot + 1] - self.bounds[slot]
        upto = np.concatenate([[0], np.cumsum(size)])
        bounds = upto[found.bounds] + np.arange(len(offsets))
        out = np.empty(int(bounds[-1]), self.dtype)
        out[bounds[1:] - 1] = end_id
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self.ids[np.arange(int(upto[-1])) + np.repeat(self.bounds[slot] - upto[:-1], size)]
        return out, bounds


@cache
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def open_file(path: str, write: bool = False):
    """An output stream, or a random-access file (memory-mapped where it is local)."""
    if "://" in path or path.startswith("file:"):
        system, inner = pafs.FileSystem.from_uri(path)
    else:
        system, inner = pafs.LocalFileSystem(), path
    if write:
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(inner)
    return pa.memory_map(inner) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(inner)


class SequenceWriter:
    """Packs a stream of ids into equal sequences and writes them in batches."""

    def __init__(self, path: str, dtype, length: int):
        self.length, self.rest, self.dtype = length, np.zeros(0, dtype), dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = open_file(path, write=True)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        self.rest = np.concatenate([self.rest, ids])
        step = self.length * BATCH_SEQUENCES
        while len(self.rest) >= step or (last and len(self.rest)):
            now = self.rest[:step]
            self.rest = self.rest[step:]
            full = np.zeros(-(-len(now) // self.length) * self.length, self.dtype)
            full[: len(now)] = now
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length)
                       for v in (full, np.arange(len(full)) < len(now))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self.add(np.zeros(0, self.dtype), last=True)
        self.writer.close()
        self.sink.close()


class SequenceFile:
    """Random access to one file's sequences, masks and token ranges, without a copy of whole batches."""

    def __init__(self, path: str):
        self.source = open_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence k."""
        batch = self.reader.get_batch(k // BATCH_SEQUENCES)
        row = k % BATCH_SEQUENCES
        return batch["ids"][row].values.to_numpy(), batch["mask"][row].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from position ``start`` to ``end`` of the file's stream."""
        step, parts = self.length * BATCH_SEQUENCES, []
        for k in range(start // step, -(-end // step)):
            ids = self.reader.get_batch(k)["ids"].flatten().to_numpy()
            parts.append(ids[max(start - k * step, 0) : end - k * step])
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, length: int = SEQUENCE,
          end_id: int = END_ID) -> DataFrame:
    """Encode and write all texts by ascending doc_id; the committed index: part, file, doc_id, offset, n_tokens."""
    folder = folder or new_path(docs.sparkSession, "token-files")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.arrow"
        encoder, writer, at = encoder_of(tokenizer_path), None, 0
        for batch in batches:
            for first, end, data, offsets in wh.chunks(batch["text"], CHUNK):
                writer = writer or SequenceWriter(path, encoder.dtype, length)
                ids, bounds = encoder.encode(data, offsets, end_id)
                writer.add(ids)
                n = end - first
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, np.int32)), pa.array([path] * n), batch["doc_id"].slice(first, n).cast(pa.int64()),
                    pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)),
                ], names=["part", "file", "doc_id", "offset", "n_tokens"])
                at += int(bounds[-1])
        if writer:
            writer.close()

    by = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return materialize(rows.sortWithinPartitions(*by).mapInArrow(task, INDEX_DDL), "token-index")


def read(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files the index names."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # one row per file
    starts = totals.select("part", before.alias("before"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            sums = []
            for path, at, n in zip(*(batch[c].to_pylist() for c in ("file", "offset", "n_tokens"))):
                if path != name:
                    name, file = path, SequenceFile(path)
                sums.append(zlib.crc32(file.tokens(at, at + n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.add(batch["before"], batch["offset"]), batch["n_tokens"], pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = index.join(starts, "part").select("doc_id", "file", "offset", "n_tokens", "before")
    files = max(totals.count(), 1)
    return rows.repartition(files, "file").sortWithinPartitions("file", "offset").mapInArrow(
        task, "doc_id long, start long, n_tokens long, ids_crc32 long")
