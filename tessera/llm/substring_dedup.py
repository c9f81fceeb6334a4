"""Exact substring deduplication by fixed-block anchors (operator 5).

A window of 13 words that occurs in two texts holds, in the one text, a whole block of
7 words from the grid of non-overlapping blocks; in the other text those 7 words are
one of the rolling windows.  So:

1. index and probe: every block sends its texts' rolling 7-word hashes to hash
   buckets, marked where the grid has them; a bucket answers which of them are in the
   index and occur at least twice (the anchors);
2. extend: every 13-word window around an anchor is sent by its full hash with the
   smallest doc_id that it starts in; a bucket answers with the smallest of all blocks;
3. words of windows that also start in a document of a smaller doc_id are marked, and
   marked windows that overlap or touch join to maximal repeats, which are removed.

No pair of texts is ever formed: a passage in a third of all documents is one key a
block in each step.  Anchors are a filter only (48-bit hashes, false hits do no harm);
windows are compared by 128 bits of hashes of 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import _blocks as B
from tessera.llm._store import freeze
from tessera.llm._words import Words, covered, mix, run_starts, runs, words

WINDOW = 13
_LOW16 = np.uint64(16)
_OTHER = np.uint64(0xA0761D6478BD642F)


def _anchor_width(window: int) -> int:
    """The widest grid that every window of ``window`` words holds a whole block of."""
    return (window + 1) // 2


def _rolling(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor-width runs of texts that have a window at all: hashes cut to 48 bits, first words, whether on the grid."""
    width = _anchor_width(window)
    h = runs(w.hash, width)
    ok = run_starts(w.first, width)
    doc = w.doc()[: len(h)]
    ok &= (w.counts >= window)[doc]
    at = np.flatnonzero(ok)
    return h[at] >> _LOW16 << _LOW16, at, (at - w.first[doc[at]]) % width == 0


def _probe_keys(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a block, rising, and two flags each: on the grid (1), more than once (2)."""
    h, _, grid = _rolling(w, window)
    order = np.argsort(h, kind="stable")
    h, grid = h[order], grid[order]
    lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    often = np.diff(np.append(lead, len(h))) > 1
    flags = np.logical_or.reduceat(grid, lead).astype(np.uint8) if len(lead) else np.zeros(0, np.uint8)
    return h[lead], flags | often.astype(np.uint8) << 1


def _text_words(rows: pa.RecordBatch) -> Words:
    return words(rows.column("text"))


def _anchors(w: Words, window: int, buckets: int, got: dict) -> np.ndarray:
    keys, _ = _probe_keys(w, window)
    keep = np.zeros(len(keys), bool)
    for bucket, lo, hi in B.bucket_ranges(keys, buckets):
        if bucket in got:
            keep[lo:hi] = B.from_bits(got[bucket][1], hi - lo)
    return keys[keep]


def _windows(w: Words, ids: np.ndarray, anchors: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes, first word and doc_id of every window around an anchor."""
    h, at, _ = _rolling(w, window)
    place = np.minimum(np.searchsorted(anchors, h), max(0, len(anchors) - 1))
    hit = np.zeros(len(w.hash), np.int64)
    if len(anchors):
        hit[at[anchors[place] == h]] = 1
    sums = np.concatenate([[0], np.cumsum(hit)])
    near = run_starts(w.first, window)
    start = np.arange(len(near))
    near &= sums[start + window - _anchor_width(window) + 1] > sums[start]
    start = start[near]
    return runs(w.hash, window)[start], runs(mix(w.hash ^ _OTHER), window)[start], start, ids[w.doc()[start]]


def _grouped(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of pairs of hashes, and which are the first of their kind in it."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], other[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort([other, h])
        a, b = h[order], other[order]
    lead = np.ones(len(h), bool)
    lead[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, lead


def _numbered(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each pair of hashes among the distinct ones, and a place of each of these."""
    order, lead = _grouped(h, other)
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(lead) - 1
    return number, order[lead]


def _smallest(h: np.ndarray, other: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of hashes, rising, the smallest doc_id of each, and whether there are others."""
    order, lead = _grouped(h, other)
    if not len(h):
        return h, other, ids, np.zeros(0, bool)
    own, at = ids[order], np.flatnonzero(lead)
    least = np.minimum.reduceat(own, at)
    return h[order[at]], other[order[at]], least, np.maximum.reduceat(own, at) > least


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    """doc_ids; a null counts as larger than all others."""
    return pc.fill_null(rows.column("doc_id").cast(pa.int64()), np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def _mark(docs: DataFrame, window: int, finish, schema) -> DataFrame:
    """``finish(rows, words, which words are removed)`` for every block of ``docs``."""
    blocks = B.write_blocks(docs)
    buckets = B.n_buckets(blocks, 6.5)

    def probe(block: int, rows: pa.RecordBatch) -> Iterator[B.Message]:
        keys, flags = _probe_keys(_text_words(rows), window)
        for bucket, lo, hi in B.bucket_ranges(keys, buckets):
            yield bucket, block, hi - lo, B.squeeze_sorted(keys[lo:hi] >> _LOW16), B.squeeze(flags[lo:hi])

    def find_anchors(bucket: int, sent: list[B.Message]) -> Iterator[B.Message]:
        keys = [B.expand_sorted(k, n, np.uint64) for _, _, n, k, _ in sent]
        flags = np.concatenate([B.expand(m, n, np.uint8) for _, _, n, _, m in sent])
        every, number = np.unique(np.concatenate(keys), return_inverse=True)
        grid = np.bincount(number, weights=flags & 1, minlength=len(every)) > 0
        often = np.bincount(number, weights=1 + (flags >> 1), minlength=len(every)) > 1
        anchor, at = (grid & often)[number], 0
        for _, block, n, _, _ in sent:
            own = anchor[at : at + n]
            if own.any():
                yield bucket, block, n, B.bits(own), b""
            at += n

    def widen(block: int, rows: pa.RecordBatch, got: dict) -> pa.RecordBatch:
        w = _text_words(rows)
        h, other, _, ids = _windows(w, _ids(rows), _anchors(w, window, buckets, got), window)
        h, other, first, several = _smallest(h, other, ids)
        out = []
        for bucket, lo, hi in B.bucket_ranges(h, buckets):
            ids_blob = B.squeeze(first[lo:hi])
            more = len(ids_blob).to_bytes(4, "little") + other[lo:hi].tobytes() + ids_blob + B.bits(several[lo:hi])
            out.append((bucket, block, hi - lo, B.squeeze_sorted(h[lo:hi]), more))
        return B.message_batch(out)

    def find_first(bucket: int, sent: list[B.Message]) -> Iterator[B.Message]:
        parts, others = [], []
        for _, block, n, keys, more in sent:
            size, at = int.from_bytes(more[:4], "little"), 4 + 8 * n
            others.append(np.frombuffer(more[4:at], np.uint64))
            parts.append((block, n, B.expand_sorted(keys, n, np.uint64), B.expand(more[at : at + size], n, np.int64), B.from_bits(more[at + size :], n)))
        number, every = _numbered(np.concatenate([p[2] for p in parts]), np.concatenate(others))
        best = np.full(len(every), np.iinfo(np.int64).max)
        np.minimum.at(best, number, np.concatenate([p[3] for p in parts]))
        at = 0
        for block, n, _, first, several in parts:
            own = best[number[at : at + n]]
            useful = several | (own < first)
            if useful.any():
                yield bucket, block, int(useful.sum()), B.bits(useful), B.squeeze(own[useful])
            at += n

    def remove(block: int, rows: pa.RecordBatch, got: dict):
        # The anchors' answers came once more, with the last ones under bucket numbers beyond theirs.
        w = _text_words(rows)
        first_got = {b - buckets: v for b, v in got.items() if b >= buckets}
        h, other, start, ids = _windows(w, _ids(rows), _anchors(w, window, buckets, {b: v for b, v in got.items() if b < buckets}), window)
        number, places = _numbered(h, other)
        every = h[places]
        best = np.full(len(every), np.iinfo(np.int64).max)
        for bucket, lo, hi in B.bucket_ranges(every, buckets):
            if bucket in first_got:
                n, useful, values = first_got[bucket]
                best[np.flatnonzero(B.from_bits(useful, hi - lo)) + lo] = B.expand(values, n, np.int64)
        gone = best[number] < ids
        return finish(rows, w, covered(start[gone], window, len(w.hash)))

    anchors = freeze(B.meet(B.ask(blocks, probe), find_anchors), "anchors")
    wide = B.told(blocks, anchors, widen, B.MESSAGE)
    firsts = B.meet(wide, find_first).withColumn("bucket", F.col("bucket") + buckets)
    return B.told(blocks, anchors.unionByName(firsts), remove, schema)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What ``dedup_substrings`` removes from each row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space)
    and spans (first words and ends, in turn, of the maximal repeats removed).  A null or
    empty text, and one shorter than a window, loses nothing; of repeated rows with one
    doc_id none counts as smaller, so they don't remove each other; a null doc_id counts
    as larger than all others; further columns are ignored; no rows give no rows.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<bigint>"

    def finish(rows: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        digests, spans, removed = [], [], []
        for d in range(w.n_docs):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            own = gone[lo:hi]
            text = w.data[w.offsets[d] : w.offsets[d + 1]].tobytes()
            kept = text.split()
            n = int(np.count_nonzero(own))
            if n:
                kept = [kept[i] for i in np.flatnonzero(~own).tolist()]
                edge = np.concatenate([[False], own, [False]])
                spans.append(np.flatnonzero(edge[1:] != edge[:-1]).tolist())
            else:
                spans.append([])
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            removed.append(n)
        return pa.record_batch(
            [rows.column("doc_id").cast(pa.int64()), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
        )

    return _mark(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), window, finish, schema)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with every repeat of at least ``window`` words cut from all texts but that of the smallest doc_id.

    All columns are kept, whatever their names; ``n_chars``, where there is one, is set to
    the new length.  Rows whose text is left without a word by this are dropped; other
    texts, null and empty ones included, are unchanged.  A null doc_id counts as larger
    than all others; repeated rows don't cut each other; no rows give no rows.
    """
    cast = docs.withColumn("text", F.col("text").cast("string")).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema: T.StructType = cast.schema

    def finish(rows: pa.RecordBatch, w: Words, gone: np.ndarray) -> pa.RecordBatch:
        text = rows.column("text").to_pylist()
        size = rows.column("n_chars").to_pylist() if "n_chars" in schema.names else None
        keep = np.ones(w.n_docs, bool)
        for d in range(w.n_docs):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            own = gone[lo:hi]
            if own.any():
                edge = np.concatenate([[True], own, [True]])
                turns = np.flatnonzero(edge[1:] != edge[:-1])  # starts and ends of what is kept
                text[d] = b"\n".join(w.data[w.start[lo + a] : w.end[lo + b - 1]].tobytes() for a, b in zip(turns[::2], turns[1::2])).decode()
                keep[d] = not own.all()
                if size is not None:
                    size[d] = len(text[d])
        new = {"text": pa.array(text, pa.string())}
        if size is not None:
            new["n_chars"] = pa.array(size, rows.schema.field("n_chars").type)
        return pa.record_batch([new.get(c, rows.column(c)) for c in schema.names], names=schema.names).filter(pa.array(keep))

    return _mark(cast, window, finish, schema)
