"""Token-id matrices by best-fit-decreasing packing (operator 1).

Each task tokenises its documents, cuts overlong ones without loss, and packs a
bounded group of pieces at a time, longest first, into the open row with the least
room that still fits; a segment tree over the room left finds that row in
``log2(seq_len)`` steps.  Rows that are not full stay open for the task's next group,
so no shuffle is needed and memory does not grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import small_batches
from tessera.llm.tokens import encoder

SEQ_LEN = 2048
END_ID = 50256
#: Tokens that a task gathers before it packs them.
GROUP_TOKENS = 1 << 20
#: Rows that stay open between two groups of a task.
OPEN_ROWS = 256

SCHEMA = (
    "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>,"
    " doc_ids array<long>, pieces array<int>, starts array<long>"
)


class RoomTree:
    """Finds the least room of at least ``need`` among the open rows, by a segment tree over rooms 0 to ``top``."""

    def __init__(self, top: int) -> None:
        self.size = 1 << top.bit_length()
        self.full = np.zeros(2 * self.size, np.int32).tolist()
        self.rows: list[list[int]] = [[] for _ in range(top + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """``(room, row)`` with the least room that is at least ``need``; the row is taken out."""
        full, at = self.full, self.size + need
        while not full[at]:
            while at & 1:  # a right child: nothing to the right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if full[2 * at] else 2 * at + 1
        room = at - self.size
        self._count(room, -1)
        return room, self.rows[room].pop()

    def _count(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.full[at] += by
            at >>= 1


class Packer:
    """Packs pieces into rows of ``seq_len`` ids; ``add`` and ``finish`` return the rows that are done."""

    def __init__(self, seq_len: int = SEQ_LEN, group_tokens: int = GROUP_TOKENS, open_rows: int = OPEN_ROWS) -> None:
        self.seq_len, self.group_tokens, self.open_rows = seq_len, group_tokens, open_rows
        self.waiting: list[tuple] = []
        self.tokens = 0
        self.open: dict[int, list[tuple]] = {}
        self.rooms: dict[int, int] = {}
        self.made = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[list[tuple]]:
        for k, start in enumerate(range(0, len(ids), self.seq_len)):
            piece = ids[start : start + self.seq_len]
            self.waiting.append((doc_id, k, start, piece))
            self.tokens += len(piece)
        return self._pack() if self.tokens >= self.group_tokens else []

    def finish(self) -> list[list[tuple]]:
        done = self._pack()
        done += [self.open[row] for row in sorted(self.open)]
        self.open, self.rooms = {}, {}
        return done

    def _pack(self) -> list[list[tuple]]:
        tree, done = RoomTree(self.seq_len), []
        for row in sorted(self.open):
            tree.add(self.rooms[row], row)
        for piece in sorted(self.waiting, key=lambda p: -len(p[3])):
            n = len(piece[3])
            found = tree.take(n)
            if found is None:
                room, row, self.made = self.seq_len, self.made, self.made + 1
                self.open[row] = []
            else:
                room, row = found
            self.open[row].append(piece)
            self.rooms[row] = room - n
            if room == n:
                done.append(self.open.pop(row))
                del self.rooms[row]
            else:
                tree.add(room - n, row)
        self.waiting, self.tokens = [], 0
        roomy = sorted(self.open, key=lambda row: (-self.rooms[row], row))
        for row in roomy[self.open_rows :]:
            done.append(self.open.pop(row))
            del self.rooms[row]
        return done


def _row(sequence_id: int, members: list[tuple], seq_len: int, pad_id: int, kind: np.dtype) -> tuple:
    lengths = [len(p[3]) for p in members]
    ids, positions = np.full(seq_len, pad_id, kind), np.zeros(seq_len, np.dtype("<u4") if seq_len > 65536 else np.dtype("<u2"))
    ends = np.cumsum(lengths)
    ids[: ends[-1]] = np.concatenate([p[3] for p in members])
    positions[: ends[-1]] = np.concatenate([np.arange(n) for n in lengths])
    return (sequence_id, int(ends[-1]), ids.tobytes(), positions.tobytes(), [0, *ends.tolist()], [p[0] for p in members], [p[1] for p in members], [p[2] for p in members])


def token_rows(docs: DataFrame, seq_len: int = SEQ_LEN, end_id: int = END_ID, tokenizer_file: str | None = None) -> DataFrame:
    """A row per packed sequence of ``seq_len`` ids for all rows of ``docs`` (doc_id, text).

    ``ids`` is one row of the id matrix: little-endian 16-bit ids (32-bit where the
    vocabulary has more than 65,536), padded with ``end_id``; ``positions`` are the
    positions, starting from 0 again in each segment; ``cu_seqlens`` the cumulative
    segment lengths, from 0 to ``n_tokens``; ``doc_ids``, ``pieces`` and ``starts`` say
    which part of which document each segment is.  Every document ends with ``end_id``;
    a null or empty text is that id alone.  Repeated rows are packed each on their own,
    a null doc_id stays null, an empty table gives no rows, further columns are ignored.
    """

    small_batches(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_file), Packer(seq_len)
        kind = np.dtype("<u2" if max(encode.vocab_size, end_id + 1) <= 65536 else "<u4")
        sequence = TaskContext.get().partitionId() << 40

        def batch_of(done: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = [_row(sequence + k, members, seq_len, end_id, kind) for k, members in enumerate(done)]
            sequence += len(done)
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            names = ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "pieces", "starts"]
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype(kind)
                if done := packer.add(doc_id, ids):
                    yield batch_of(done)
        if done := packer.finish():
            yield batch_of(done)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def write_token_rows(docs: DataFrame, path: str, **options) -> None:
    """``token_rows`` written as Parquet, a file per task."""
    token_rows(docs, **options).write.parquet(path)


def unpack(rows: DataFrame) -> DataFrame:
    """The documents' ids again, from ``token_rows``: doc_id, piece, start and the ids of each segment."""
    segments = rows.select(
        "ids",
        (F.octet_length("ids") / F.octet_length("positions") * 2).cast("int").alias("width"),
        F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("k", "part"),
        "cu_seqlens",
    )
    first = F.expr("cu_seqlens[k]")
    size = F.expr("cu_seqlens[k + 1] - cu_seqlens[k]")
    return segments.select(
        F.col("part.doc_ids").alias("doc_id"),
        F.col("part.pieces").alias("piece"),
        F.col("part.starts").alias("start"),
        F.substring(F.col("ids"), first * F.col("width") + 1, size * F.col("width")).alias("ids"),
    )
