"""Best-fit packing by length patterns (operator 9).

Documents are tokenised once; after that only their lengths matter.  The length
histogram has at most ``seq_len`` rows whatever the corpus size, so the plan is made
on the driver: all patterns of one to three lengths that fill a sequence are enumerated,
non-negative least squares fits how often each repeats, the counts are rounded,
and what is left over is packed best-fit-decreasing on the histogram.  The plan says,
for each length, which rank goes to which pattern slot; ranks are handed out by
prefix sums over the tasks that tokenised, so no group of equal lengths meets in a task.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm._store import freeze, release, small_batches
from tessera.llm.tokens import encoder

SEQ_LEN = 2048
END_ID = 0

_PIECES = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank_in_part")]
)
_PLACED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id",)]
    + [T.StructField("piece", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "sequence_id", "offset")]
)


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: whole sequences, the first may be shorter."""
    if n <= seq_len:
        return [(0, n)]
    first = n % seq_len or seq_len
    return [(0, first), *((s, seq_len) for s in range(first, n, seq_len))]


def pieces(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = END_ID, tokenizer_file: str | None = None) -> DataFrame:
    """A row per piece of each row of ``docs`` (null text: empty), with its place among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), seq_len)):
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    out.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, rank))
            columns = zip(*out) if out else [[]] * len(_PIECES)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=_PIECES.names)
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


def enumerate_patterns(lengths: np.ndarray, seq_len: int) -> list[np.ndarray]:
    """All patterns of one, two or three of ``lengths`` that fill a sequence exactly, longest first: at most about seq_len**2 / 12."""
    have = np.zeros(seq_len + 1, bool)
    have[lengths] = True
    out = [np.array([[seq_len]])] if have[seq_len] else []
    a = np.arange(1, seq_len // 2 + 1)
    a = a[have[a] & have[seq_len - a]]
    if len(a):
        out.append(np.stack([seq_len - a, a], 1))
    triples = []
    for x in np.flatnonzero(have[: seq_len - 1]).tolist():
        # The second is no longer than the first, and the third no longer than the second.
        y = np.arange(-(-(seq_len - x) // 2), min(x, seq_len - x - 1) + 1)
        y = y[have[y] & have[seq_len - x - y]]
        if len(y):
            triples.append(np.stack([np.full(len(y), x), y, seq_len - x - y], 1))
    return [*out, np.concatenate(triples)] if triples else out


def nonnegative_fit(patterns: list[np.ndarray], counts: np.ndarray, steps: int = 200) -> list[np.ndarray]:
    """Repeat counts ``x >= 0`` that minimise ``|A x - counts|`` weighted to relative error, by accelerated projected gradients."""
    if not patterns:
        return []
    flat = np.concatenate([p.ravel() for p in patterns])
    owner = np.concatenate([np.repeat(np.arange(len(p)), p.shape[1]) + sum(len(q) for q in patterns[:i]) for i, p in enumerate(patterns)])
    n, m = sum(len(p) for p in patterns), len(counts)
    weight = 1 / np.sqrt(np.maximum(counts, 1.0))
    degree = np.bincount(flat, minlength=m).astype(float)
    # A row and a column scaling that bounds the largest singular value by one.
    width = np.bincount(owner, minlength=n).astype(float)
    scale = 1 / np.sqrt(width * np.array(np.maximum.reduceat(degree[flat] * weight[flat] ** 2, np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))))
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        rest = np.bincount(flat, weights=(scale * y)[owner], minlength=m) - counts
        grad = scale * np.bincount(owner, weights=(weight**2 * rest)[flat], minlength=n)
        new = np.maximum(0, y - grad)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    fitted = scale * x
    ends = np.cumsum([len(p) for p in patterns])[:-1]
    return np.split(fitted, ends)


def best_fit_decreasing(counts: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing of ``{length: count}``, in runs of equal bins: ``[(lengths, bins)]``."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    caps: list[int] = []

    def put(room: int, members: tuple[int, ...], bins: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            bisect.insort(caps, room)
        open_bins[room].append((members, bins))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(caps, length)
            if at == len(caps):
                each = seq_len // length
                full, rest = divmod(left, each)
                if full:
                    put(seq_len - each * length, (length,) * each, full)
                if rest:
                    put(seq_len - rest * length, (length,) * rest, 1)
                break
            room = caps[at]
            members, bins = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                caps.pop(at)
            took = min(left, bins)
            left -= took
            put(room - length, (*members, length), took)
            if bins > took:
                put(room, members, bins - took)
    return [x for runs in open_bins.values() for x in runs]


def _fitted(histogram: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan of fitted patterns; what they leave is packed best-fit-decreasing."""
    counts = np.zeros(seq_len + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    groups = enumerate_patterns(np.flatnonzero(counts), seq_len)
    left, out, sums = counts.tolist(), [], 0.0
    for group, repeats in zip(groups, nonnegative_fit(groups, counts.astype(float))):
        # Running sums are rounded, so that many small counts don't all round to none.
        steps = np.floor(sums + np.concatenate([[0.0], np.cumsum(repeats)]) + 0.5).astype(np.int64)
        whole = np.diff(steps)
        sums += float(repeats.sum())
        some = np.flatnonzero(whole)
        for lengths, n in zip(group[some].tolist(), whole[some].tolist()):
            n = min(n, *(left[v] // lengths.count(v) for v in lengths))
            if n > 0:
                for v in lengths:
                    left[v] -= n
                out.append((tuple(lengths), n))
    return out + best_fit_decreasing({v: n for v, n in enumerate(left) if n}, seq_len)


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """``[(lengths of a sequence, how many such sequences)]`` covering the histogram exactly: by fitted patterns, or by best fit alone where that takes fewer."""
    return min(_fitted(histogram, seq_len), best_fit_decreasing(histogram, seq_len), key=lambda found: sum(n for _, n in found))


def _slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows of (first rank, first sequence, offset), by rank."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, n in planned:
        offset = 0
        for length in lengths:
            slots.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = END_ID, tokenizer_file: str | None = None) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text) into sequences of at most ``seq_len`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    A null or empty text is one piece that holds the end id alone.  Repeated rows are
    packed each on their own; a null doc_id stays null; an empty table gives no rows;
    columns besides doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    cuts = freeze(pieces(docs, seq_len, end_id, tokenizer_file), "pieces")
    # At most seq_len rows of histogram reach the driver.
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(histogram, seq_len))
    per_part = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for v in np.unique(length):
                own = length == v
                table = slots[int(v)]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = row[:, 1] + rank[own] - row[:, 0], row[:, 2]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            kept[1] = kept[1].cast(pa.int32())
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], names=_PLACED.names)

    ranked = cuts.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("rank_in_part"))
    return ranked.mapInArrow(place, _PLACED)
