"""Words of Arrow string columns as numpy arrays: where they start and end, whose they are, and 64-bit hashes.

A word's hash is a polynomial over random 64-bit codes of its bytes, finished by a
mixer, so equal words have equal hashes in every task, and different words collide
with a chance of about 2**-60.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that part words: the space and \x09-\x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part words of lower-cased letters, digits and non-ASCII characters.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes hashed at a time, so that scratch arrays stay small whatever a text's length.
_STRIDE = 1 << 17
#: Bytes of which words are sought at a time.
_STRETCH = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER_CODES = _CODES[LOWER]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = 2 * _STRIDE + 1
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """Words of ``n_docs`` texts. ``first``: the index of each text's first word, and the number of all words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.n_docs), self.counts)

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, gaps: np.ndarray = BLANK, lower: bool = False) -> Words:
    """The words of every text: longest runs of bytes that ``gaps`` doesn't hold, within one text; ``lower``: hashed in lower case.

    Only their places and hashes take memory beside the texts; flags are made a stretch at a time.
    """
    data, offsets = string_buffers(column)
    n, starts, ends = len(data), [], []
    gaps = gaps[LOWER] if lower else gaps
    for lo in range(0, n, _STRETCH):
        hi = min(n, lo + _STRETCH)
        # One byte more on both sides, where there is one.
        inside = np.zeros(hi - lo + 2, bool)
        a, b = max(0, lo - 1), min(n, hi + 1)
        inside[a - lo + 1 : b - lo + 1] = ~gaps[data[a:b]]
        edge = np.zeros(hi - lo + 1, bool)
        edge[offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo] = True
        own = inside[1:-1]
        starts.append(np.flatnonzero(own & (~inside[:-2] | edge[:-1])) + lo)
        ends.append(np.flatnonzero(own & (~inside[2:] | edge[1:])) + lo + 1)
    start, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, first, _hashes(data, start, end, _LOWER_CODES if lower else _CODES))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray) -> np.ndarray:
    up, down = _powers()
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        # Words that begin within a stride; a longer one is hashed on its own.
        j = max(i + 1, int(np.searchsorted(end, start[i] + _STRIDE, side="right")))
        lo, hi = int(start[i]), int(end[j - 1])
        if hi - lo > 2 * _STRIDE:
            h = np.uint64(0)
            for k in range(lo, hi, _STRIDE):
                part = data[k : min(hi, k + _STRIDE)]
                h = mix(np.array([h ^ np.sum(codes[part] * up[: len(part)], dtype=np.uint64)]))[0]
            out[i] = h
        else:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(codes[data[lo:hi]] * up[: hi - lo], out=sums[1:])
            a, b = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words, by the first one's index; those that cross texts are the caller's to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    odd = mix(np.arange(7, 7 + n, dtype=np.uint64)) | np.uint64(1)
    for k in range(n):
        out += hashes[k : k + len(out)] * odd[k]
    return mix(out)


def run_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Whether ``n`` words of one text start at each word that ``runs`` has a hash for."""
    total = int(first[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for k in range(1, n):  # the word k before a text's end starts no run
        ends = first[1:] - k
        ends = ends[(ends >= first[:-1]) & (ends < len(ok))]
        ok[ends] = False
    return ok


def covered(start: np.ndarray, length: int | np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a run of ``length`` words that starts at one of ``start``."""
    change = np.zeros(total + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def slices(batch: pa.RecordBatch, column: str, most: int, most_rows: int = 1 << 62) -> list[pa.RecordBatch]:
    """The batch in runs of rows with up to ``most`` bytes of text each; a longer text is on its own."""
    if not batch.num_rows:
        return []
    _, offsets = string_buffers(batch.column(column))
    out, lo = [], 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, lo + most_rows)
        out.append(batch.slice(lo, hi - lo))
        lo = hi
    return out
