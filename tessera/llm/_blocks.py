"""Blocks of documents, and compact messages between blocks and hash buckets.

Operators that compare every word of every document with all others write the
documents once, as compressed blocks, into a table bucketed by block number.  What a
block asks of the corpus is sent to hash buckets as sorted, compressed key arrays, one
message per block and bucket; answers come back per block and meet the table's
bucket without moving a text.  Equal keys of a block are sent once, so a key that
holds a third of all rows costs one entry a block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import fresh_path, release, small_batches
from tessera.llm._words import slices, string_buffers

#: Text of a block; beyond about a terabyte, raise it with the size of an input split.
BLOCK_BYTES = 4 << 20
#: Rows of a block at most; a row's number is its block's, shifted by so many bits, and its place there.
BLOCK_BITS = 16
BLOCK_ROWS = 1 << BLOCK_BITS
#: Keys that a bucket holds, about.
BUCKET_KEYS = 3_000_000

_ZSTD = pa.Codec("zstd", compression_level=1)


def squeeze(x: np.ndarray) -> bytes:
    """Bytes of an array, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else np.zeros(0, np.uint8)
    return _ZSTD.compress(planes.tobytes(), asbytes=True)


def expand(blob: bytes, n: int, kind: type) -> np.ndarray:
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(blob, n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    """``squeeze`` of the steps of a rising unsigned array."""
    return squeeze(np.diff(x, prepend=x.dtype.type(0)))


def expand_sorted(blob: bytes, n: int, kind: type) -> np.ndarray:
    return np.cumsum(expand(blob, n, kind), dtype=kind)


def bits(x: np.ndarray) -> bytes:
    return _ZSTD.compress(np.packbits(x).tobytes(), asbytes=True)


def from_bits(blob: bytes, n: int) -> np.ndarray:
    raw = _ZSTD.decompress(blob, (n + 7) // 8, asbytes=True) if n else b""
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def bucket_ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """``(bucket, from, to)`` of the parts of sorted 64-bit keys, dealt by their high 32 bits; empty parts are left out.

    The work is that of the keys, however many buckets there are, and there are no more parts than keys.
    """
    if not len(keys):
        return []
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return list(zip(bucket[lead].tolist(), lead.tolist(), [*lead[1:].tolist(), len(keys)]))


def _pack(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for row in rows:
            out.write_batch(row)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(payload).read_all().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)


Rewrite = Callable[[pa.RecordBatch], pa.RecordBatch]


def write_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, column: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``docs`` as a table of (block long, n_bytes long, payload binary), bucketed by block; a payload is ``rewrite`` of a block's rows.

    The rows are written where they are read: a block never leaves its task.  The
    catalog knows the table only until its files and their bucketing are read from there.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count, block = [], 0, 0, TaskContext.get().partitionId() << 24

        def flush() -> pa.RecordBatch:
            rows = held if rewrite is None else [rewrite(pa.Table.from_batches(held).combine_chunks().to_batches()[0])]
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([_pack(rows)], pa.binary())], names=["block", "n_bytes", "payload"])

        for batch in batches:
            for part in slices(batch, column, block_bytes, BLOCK_ROWS):
                n = int(string_buffers(part.column(column))[1][-1])
                if held and (size + n > block_bytes or count + part.num_rows > BLOCK_ROWS):
                    yield flush()
                    held, size, count, block = [], 0, 0, block + 1
                held, size, count = [*held, part], size + n, count + part.num_rows
        if held:
            yield flush()
        release()

    name = f"tessera_blocks_{uuid.uuid4().hex}"
    packed = docs.mapInArrow(run, "block long, n_bytes long, payload binary")
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    packed.write.bucketBy(buckets, "block").option("path", fresh_path(spark, "blocks")).option("compression", "uncompressed").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def row_ids(block: int, n: int) -> np.ndarray:
    """The numbers of a block's rows."""
    return (block << BLOCK_BITS) + np.arange(n, dtype=np.int64)


def n_buckets(blocks: DataFrame, bytes_per_key: float) -> int:
    """Buckets for a key every ``bytes_per_key`` bytes of the blocks' text."""
    size = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(8, -(-int(size / bytes_per_key) // BUCKET_KEYS))


Message = tuple[int, int, int, bytes, bytes]  # bucket, block, n, keys, more

MESSAGE = "bucket int, block long, n long, keys binary, more binary"


def message_batch(rows: Iterable[Message]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "block", "n", "keys", "more"])


def ask(blocks: DataFrame, messages: Callable[[int, pa.RecordBatch], Iterator[Message]]) -> DataFrame:
    """The messages that ``messages(block, rows)`` makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                yield message_batch(messages(block, unpack(payload.as_py())))
                release()

    return blocks.select("block", "payload").mapInArrow(run, MESSAGE)


def meet(messages: DataFrame, answers: Callable[[int, list[Message]], Iterator[Message]]) -> DataFrame:
    """``answers(bucket, messages of it)`` for each bucket: messages back to blocks."""

    def run(table: pa.Table) -> pa.Table:
        rows = [tuple(r.values()) for r in table.select(["bucket", "block", "n", "keys", "more"]).to_pylist()]
        rows.sort(key=lambda r: r[1])
        out = pa.Table.from_batches([message_batch(answers(rows[0][0], rows))])
        release()
        return out

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def told(blocks: DataFrame, answers: DataFrame, act: Callable[[int, pa.RecordBatch, dict[int, tuple[int, bytes, bytes]]], pa.RecordBatch | pa.Table], schema) -> DataFrame:
    """``act(block, rows, {bucket: (n, keys, more)})`` for each block, with the answers to it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.column("block")[0].as_py()
        got = {b: (n, k, m) for b, n, k, m in zip(*(right.column(c).to_pylist() for c in ("bucket", "n", "keys", "more")))}
        out = act(block, unpack(left.column("payload")[0].as_py()), got)
        release()
        return out if isinstance(out, pa.Table) else pa.Table.from_batches([out])

    return blocks.select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
