"""Vectorised word and shingle hashes of whole texts, for the Arrow tasks of this subpackage.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Both rules are about
single ASCII bytes, so UTF-8 text is handled as one byte array per batch: word
borders are a table look-up, and the hash of a word sums its blocks of eight bytes, each
mixed with its place in the word, and mixes the sum with the word's length.  No step is
linear in the bytes, so words of a regular structure do not collide.  No Python loop runs
over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
SHINGLE = 5
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte but letters and digits: words without their punctuation.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: _BYTES[n] keeps the first n bytes of a little-endian block of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, without a copy; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about ``most`` bytes each."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words of a run of texts: ``hashes[bounds[i]:bounds[i + 1]]`` belong to text i."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the block that starts at each byte
    size = ends - starts
    total = mix(eight[starts] & _BYTES[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        blocks = (size[long] - 1) >> 3  # those after the first
        upto = np.cumsum(blocks)
        place = np.arange(1, upto[-1] + 1) - np.repeat(upto - blocks, blocks)
        at = np.repeat(starts[long], blocks) + 8 * place
        left = np.minimum(np.repeat(ends[long], blocks) - at, 8)
        rest = mix((eight[at] & _BYTES[left]) + mix(place.astype(np.uint64) * np.uint64(BASE)))
        total[long] += np.add.reduceat(rest, upto - blocks)
    return mix(total + size.astype(np.uint64) * np.uint64(BASE))


def words(data: np.ndarray, offsets: np.ndarray, borders: np.ndarray = SPACE, prefix: int = 0) -> Words:
    """Every word's byte span and 64-bit hash, A-Z lower-cased; with ``prefix``, of its first bytes only."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64))
    inside = ~borders[data]
    first, last = inside.copy(), inside.copy()
    border = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    fresh = np.zeros(len(data), bool)
    fresh[0] = True
    fresh[border] = True
    first[1:] &= ~inside[:-1] | fresh[1:]
    last[:-1] &= ~inside[1:] | fresh[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hashes(lowered(data), starts, np.minimum(ends, starts + prefix) if prefix else ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def ngrams(hashes: np.ndarray, offsets: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of (word i + offsets[0], word i + offsets[1], ...) for every i it fits; (0, 2) is a skip-gram."""
    n = len(hashes) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, salt + len(offsets), np.uint64)
    for k, at in enumerate(offsets):
        total = total * np.uint64(BASE) + (hashes[at : at + n] ^ np.uint64(k))
    return mix(total)


def shingle_sets(found: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer than ``size`` words has its whole sequence as one shingle;
    one without words has none.
    """
    every = ngrams(found.hashes, tuple(range(size)))
    sets = []
    for a, b in zip(found.bounds[:-1], found.bounds[1:]):
        if b - a >= size:
            sets.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            sets.append(ngrams(found.hashes[a:b], tuple(range(b - a)), salt=1 << 20))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
