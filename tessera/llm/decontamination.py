"""Benchmark decontamination by FM-indexes of training shards (operator 8).

Each task cuts its documents' words into shards of a bounded number of words and
builds an FM-index of each: a suffix array by prefix doubling, its Burrows-Wheeler
transform in a wavelet matrix, and sampled suffix positions.  All benchmark windows
are searched backwards through the index at once; hits are located by walking to a
sampled position, and the hit words are merged into removal spans.  Nothing is
shuffled, and a shard's index lives only while the shard is searched.

The benchmark is the stated query set.  It reaches the tasks in blocks of at most
``BLOCK_BYTES`` of text, one pass over the documents a block; a block's windows are
arrays of word numbers, and neither driver nor tasks hold two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import discard, freeze, release, small_batches
from tessera.llm._words import NOT_ALNUM, mix, run_starts, runs, slices, words

WINDOW = 10
#: Words of a shard.
SHARD = 1 << 19
#: Every so many positions of a shard are kept in its index.
SAMPLE = 8
#: Benchmark text that is sent to every task at a time; its windows take some ten times as much for a moment on the driver.
BLOCK_BYTES = 8 << 20
_OTHER = np.uint64(0xA0761D6478BD642F)
#: Document text that a task holds at a time.
TEXT_BYTES = 4 << 20
#: Columns that travel between passes, by names that no table has.
SPANS, ITEMS = "_tessera_hit_spans", "_tessera_hit_items"


@dataclass
class Phrases:
    """Distinct benchmark windows by length, as places in ``number``: the benchmark's words, numbered in ``vocabulary``."""

    vocabulary: np.ndarray
    number: np.ndarray
    by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # length, a place of each window, first item of each, items


def phrases(items: pa.Array, text: pa.Array, window: int = WINDOW) -> Phrases:
    """Windows of all items; an item of fewer words, but not none, is one window.

    Windows are told apart by 128 bits of hashes.
    """
    w = words(text, NOT_ALNUM, lower=True)
    item, doc, counts = items.to_numpy(), w.doc(), w.counts
    vocabulary, number = np.unique(w.hash, return_inverse=True)
    by_length = []
    for n in range(1, window + 1):
        at = np.flatnonzero(run_starts(w.first, n))
        own = counts[doc[at]]
        at = at[(own == n) if n < window else (own >= n)]
        if not len(at):
            continue
        one, two = runs(w.hash, n)[at], runs(mix(w.hash ^ _OTHER), n)[at]
        order = np.lexsort([item[doc[at]], two, one])
        at, one, two = at[order], one[order], two[order]
        own = item[doc[at]]
        lead = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        each = lead | np.concatenate([[True], own[1:] != own[:-1]])
        first = np.append(np.flatnonzero(lead[each]), np.count_nonzero(each))
        by_length.append((n, at[lead].astype(np.int32), first, own[each]))
    return Phrases(vocabulary, number.astype(np.int32), by_length)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of ``s`` (values from 0 to below 2**21): by three symbols first, then doubling within groups that are still equal."""
    n = len(s)
    padded = np.concatenate([s.astype(np.int64) + 1, np.zeros(2, np.int64)])
    key = padded[:n] << 42 | padded[1 : n + 1] << 21 | padded[2 : n + 2]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = lead
    h = 3
    slot = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slot):
        at = order[slot]
        ahead = at + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slot] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slot[np.maximum.accumulate(np.where(new, np.arange(len(slot)), 0))]
        slot = slot[~(new & np.append(new[1:], True))]
        h *= 2
    return order


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many symbols and places at once."""

    def __init__(self, sequence: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (sequence >> bit) & 1
            sums = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(ones, out=sums[1:])
            zeros = len(sequence) - int(sums[-1])
            self.levels.append((bit, sums, zeros))
            flags = ones.astype(bool)
            sequence = np.concatenate([sequence[~flags], sequence[flags]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(at), at
        for bit, sums, zeros in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            low = np.where(one, zeros + sums[low], low - sums[low])
            high = np.where(one, zeros + sums[high], high - sums[high])
        return high - low


class FMIndex:
    """Searches phrases of a benchmark vocabulary in one shard of words.

    Words outside the vocabulary share a symbol in the transform: no phrase has them,
    and a walk that meets one stops there, as the suffixes that they precede are kept.
    """

    def __init__(self, shard: np.ndarray, vocabulary: np.ndarray, sample: int = SAMPLE) -> None:
        # A separator ends the shard, so that every word of the vocabulary has a suffix after it that is a row too.
        shard = np.append(shard, np.uint64(0))
        n = len(shard)
        local, number = np.unique(shard, return_inverse=True)
        at = np.minimum(np.searchsorted(vocabulary, local), len(vocabulary) - 1)
        known = np.where(vocabulary[at] == local, at, len(vocabulary))
        sa = suffix_array(number)
        before = known[number[sa - 1]]
        before[sa == 0] = len(vocabulary)  # nothing stands before the first word
        starts = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(local)))])
        self.n, self.before = n, before
        self.starts = np.zeros(len(vocabulary) + 1, np.int64)
        self.starts[known] = starts[:-1]
        self.there = np.zeros(len(vocabulary) + 1, bool)
        self.there[known] = True
        self.tree = WaveletMatrix(before, len(vocabulary) + 1)
        self.kept = (sa % sample == 0) | (before == len(vocabulary))
        self.kept_rank = np.concatenate([[0], np.cumsum(self.kept)])
        self.positions = sa[self.kept]

    def search(self, number: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """``(window, position)`` of every occurrence of the ``length`` words of ``number`` from each of ``places``."""
        there = self.there[number]
        alive = np.arange(len(places))
        for j in range(length):
            alive = alive[there[places[alive] + j]]
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for j in range(length - 1, -1, -1):
            symbol = number[places[alive] + j]
            low = self.starts[symbol] + self.tree.rank(symbol, low)
            high = self.starts[symbol] + self.tree.rank(symbol, high)
            some = high > low
            alive, low, high = alive[some], low[some], high[some]
        times = high - low
        window = np.repeat(alive, times)
        row = np.repeat(low - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        return window, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The shard position of each row of the suffix array."""
        row, steps = row.copy(), np.zeros(len(row), np.int64)
        walking = np.flatnonzero(~self.kept[row])
        while len(walking):
            symbol = self.before[row[walking]]
            row[walking] = self.starts[symbol] + self.tree.rank(symbol, row[walking])
            steps[walking] += 1
            walking = walking[~self.kept[row[walking]]]
        return self.positions[self.kept_rank[row]] + steps


def hits(text: pa.Array, known: Phrases, shard: int = SHARD) -> tuple:
    """Words of the texts, which of them are hit, and the distinct ``(text, item)`` pairs of occurring windows."""
    w = words(text, NOT_ALNUM, lower=True)
    hit, pairs = np.zeros(int(w.first[-1]) + 1, np.int32), []
    # A separator, which no phrase has, follows each text; a text's words thus shift by its number.
    sequence = np.insert(w.hash, w.first[1:], np.uint64(0))
    longest = max((n for n, *_ in known.by_length), default=1)
    for lo in range(0, len(sequence), shard):
        part = sequence[lo : lo + shard + longest - 1]
        index = FMIndex(part, known.vocabulary)
        for n, places, first, items in known.by_length:
            window, at = index.search(known.number, places, n)
            if not len(window):
                continue
            at = at + lo
            owner = np.searchsorted(w.first[1:] + np.arange(w.n_docs), at)
            np.add.at(hit, at - owner, 1)
            np.add.at(hit, at - owner + n, -1)
            each = first[window + 1] - first[window]
            item = items[np.repeat(first[window] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())]
            pairs.append(np.unique(np.stack([np.repeat(owner, each), item], 1), axis=0))
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return w, np.cumsum(hit[:-1]) > 0, both


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """Distinct items in blocks of about ``block_bytes`` of text at most, dealt by a hash; an item with a null id is left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * size // block_bytes) if size > block_bytes else 1
    for k in range(n):
        yield (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toArrow().combine_chunks()


def _search(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``finish`` of every slice of ``docs`` with the 0-based word spans that are hit (starts and ends in turn) and the items found.

    A pass for each block of the benchmark.  All but the last write the documents with
    their hits, so that one block at a time is with the tasks; the last one finishes, so
    that one block needs one pass.
    """
    small_batches(docs.sparkSession)
    out = docs.select("*", F.expr("cast(array() as array<bigint>)").alias(SPANS), F.expr("cast(array() as array<bigint>)").alias(ITEMS))
    waiting: Phrases | None = None
    for block in _blocks(benchmark, block_bytes):
        known = phrases(block.column("item_id").combine_chunks(), block.column("text").combine_chunks(), window)
        if known.by_length:
            if waiting is not None:
                out = _pass(docs, out, waiting)
            waiting = known
    sent = docs.sparkSession.sparkContext.broadcast(waiting)
    return out.mapInArrow(_searcher(sent, out.columns, finish), schema)


def _pass(docs: DataFrame, rows: DataFrame, known: Phrases) -> DataFrame:
    """``rows`` with the hits of one block of the benchmark, frozen."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    out = freeze(rows.mapInArrow(_searcher(sent, rows.columns, None), rows.schema), "hits")
    sent.destroy()
    if hasattr(rows, "frozen"):
        discard(docs.sparkSession, rows.frozen)
    return out


def _searcher(sent, columns: list[str], finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                if sent.value is not None:
                    part = _with_hits(part, sent.value, columns)
                yield finish(part) if finish is not None else part
                release()

    return run


def _with_hits(part: pa.RecordBatch, known: Phrases, columns: list[str]) -> pa.RecordBatch:
    # Copies in the same slice are searched once.
    coded = pc.dictionary_encode(pc.fill_null(part.column("text"), ""))
    w, hit, pairs = hits(coded.dictionary, known)
    text_of = coded.indices.to_numpy()
    spans_of: dict[int, list[int]] = {}
    items_of: dict[int, list[int]] = {}
    for d, item in pairs.tolist():
        items_of.setdefault(d, []).append(item)
    for d in items_of:
        own = np.concatenate([[False], hit[w.first[d] : w.first[d + 1]], [False]])
        spans_of[d] = np.flatnonzero(own[1:] != own[:-1]).tolist()
    spans, items = part.column(SPANS).to_pylist(), part.column(ITEMS).to_pylist()
    for row, d in enumerate(text_of.tolist()):
        if d in items_of:
            spans[row] = merged(spans[row], spans_of[d])
            items[row] = sorted({*items[row], *items_of[d]})
    new = {SPANS: pa.array(spans, pa.list_(pa.int64())), ITEMS: pa.array(items, pa.list_(pa.int64()))}
    return pa.record_batch([new.get(c, part.column(c)) for c in columns], names=columns)


def merged(a: list[int], b: list[int]) -> list[int]:
    """The union of two lists of spans (starts and ends in turn); spans that touch become one."""
    out: list[int] = []
    for lo, hi in sorted([*zip(a[::2], a[1::2]), *zip(b[::2], b[1::2])]):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): how much of it occurs in ``benchmark`` (item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hit_spans.
    A null or empty text has no words and is clean; items without words match nothing;
    items with a null id are left out; rows of one item_id count as one item; repeated
    documents get a row each; further columns of either table are ignored; an empty
    benchmark leaves all clean, and no documents give no rows.
    """
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<bigint>"

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        spans, items = part.column(SPANS).to_pylist(), part.column(ITEMS).to_pylist()
        n_hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
        digest = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
        n_words = words(part.column("text"), NOT_ALNUM, lower=True).counts
        return pa.record_batch(
            [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_()), part.column(SPANS)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
        )

    return _search(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), benchmark, window, block_bytes, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the benchmark's words: each hit span is cut from ``text`` and a line break left in its place.

    All columns are kept; ``n_chars``, where there is one, is set to the new length.
    Rows whose text is left without a word are dropped, others stay; a clean text, null
    included, is unchanged.  Items with a null id or no words match nothing; an empty
    benchmark leaves all as it was; repeated rows stay as often as they are; further
    columns may have any name; no documents give no rows.
    """
    columns = docs.columns
    cast = docs.withColumn("text", F.col("text").cast("string"))

    def finish(part: pa.RecordBatch) -> pa.RecordBatch:
        spans, text = part.column(SPANS).to_pylist(), part.column("text").to_pylist()
        w = words(part.column("text"), NOT_ALNUM, lower=True)
        keep = [True] * len(text)
        for row, own in enumerate(spans):
            if own:
                text[row] = _cut(text[row], w, row, own)
                keep[row] = sum(own[1::2]) - sum(own[::2]) < w.counts[row]
        new = {"text": pa.array(text, pa.string())}
        if "n_chars" in columns:
            changed = [len(t) if own else n for t, own, n in zip(text, spans, part.column("n_chars").to_pylist())]
            new["n_chars"] = pa.array(changed, part.schema.field("n_chars").type)
        return pa.record_batch([new.get(c, part.column(c)) for c in columns], names=columns).filter(pa.array(keep))

    return _search(cast, benchmark, window, block_bytes, finish, cast.schema)


def _cut(text: str, w, row: int, spans: list[int]) -> str:
    raw, shift, out, at = text.encode(), int(w.offsets[row]), [], 0
    for lo, hi in zip(spans[::2], spans[1::2]):
        out.append(raw[at : int(w.start[w.first[row] + lo]) - shift])
        at = int(w.end[w.first[row] + hi - 1]) - shift
    return b"\n".join([*out, raw[at:]]).decode()
