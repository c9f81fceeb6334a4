"""WARC archives: a writer for pages, and a PySpark Python data source (operator 2).

Archives are gzip files with a member for each record; a member's extra field ``sl``
says how long it is, compressed and plain, so that a reader can pass over it.  The data
source plans partitions of whole files, takes predicates on record type and headers,
reads a record's headers first, and neither inflates nor decodes the payload of a
record that the predicates, or the ``payload`` option, don't ask for.  Archives without
the extra field, and plain ``.warc`` files, are read too.

Files are reached through ``pyarrow.fs``, so any store that it knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from tessera.llm._store import discard, fresh_path, uri

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
#: A new file is begun beyond so many bytes; a partition reads files of so many.
FILE_BYTES = 32 << 20
PARTITION_BYTES = 32 << 20
#: The largest length that a member's extra field can say.
MOST_KNOWN = (1 << 32) - 1

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to string, payload_bytes long, payload_digest string, headers map<string,string>, payload binary"

#: Columns that are known from a record's headers alone, and the headers.
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}

#: What ends every record.
RECORD_END = b"\r\n\r\n"

_PAGE_URN = re.compile(r"<urn:page:(-?\d+)>")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(plain: bytes) -> bytes:
    """A gzip member whose extra field holds its own and its plain length; without the field where 32 bits can't hold them."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    known = max(whole, len(plain)) <= MOST_KNOWN
    extra = struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, whole, len(plain)) if known else b""
    head = b"\x1f\x8b\x08" + (b"\x04" if known else b"\x00") + bytes(4) + b"\x00\xff"
    return head + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record with the payload, or a revisit record without."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else 'null'}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, "", ""]).encode() + block + RECORD_END


def write_pages(pages: DataFrame, path: str, least_revisit: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> int:
    """Writes a record for each row of ``pages`` (page_id, url, html) to archives in ``path``; returns the number of files.

    Rows with equal payloads of at least ``least_revisit`` bytes: those with the largest
    page_id (each of them, if several rows have it) are responses, the others revisit it.
    A null html is an empty payload; a null page_id counts as the smallest.
    """
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    spark = pages.sparkSession
    winners_path = fresh_path(spark, "winners")
    copies = keyed.where(F.octet_length("html") >= least_revisit).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies.write.mode("overwrite").parquet(winners_path)
    # Both sides are read by the join's own exchanges, so that Spark can split a page that has very many copies.
    joined = keyed.join(spark.read.schema(copies.schema).parquet(winners_path), "sha", "left").drop("sha")
    path = uri(path)
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        name, done, out = f"part-{context.partitionId():05d}-{context.taskAttemptId()}", [], None
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first"))):
                if out is None:
                    done.append(f"{name}-{len(done):04d}.warc.gz")
                    out = store.open_output_stream(f"{folder}/{done[-1]}", compression=None)
                revisit = first.is_valid and page_id.as_py() != first.as_py()
                out.write(_member(record(page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py(), revisit)))
                if out.tell() >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.record_batch([pa.array(done, pa.string())], names=["file"])

    # Names of whole files only: what a failed attempt has left is not among them.
    files = [r["file"] for r in joined.mapInArrow(run, "file string").collect()]
    with store.open_output_stream(f"{folder}/_files.json") as out:
        out.write(json.dumps(sorted(files)).encode())
    discard(spark, winners_path)
    return len(files)


class _Files(InputPartition):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", folder or file)``; option ``payload`` false: payloads are not decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = uri(options["path"])
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership on columns that headers decide; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, frozenset([f.value])))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, frozenset(f.value)))
            elif column in ("record_id", "record_type") and isinstance(f, IsNotNull):
                continue
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [(path, info.size)]
        else:
            every = {f.path: f.size for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File}
            listed = f"{path}/_files.json"
            if listed in every:
                with store.open_input_stream(listed) as own:
                    found = [(f"{path}/{n}", every[f"{path}/{n}"]) for n in json.loads(own.read())]
            else:
                found = sorted((p, s) for p, s in every.items() if re.search(r"\.warc(\.gz)?$", p))
        out, held, size = [], [], 0
        for name, n in found:
            if held and size + n > self.partition_bytes:
                out.append(_Files(held))
                held, size = [], 0
            held, size = [*held, name], size + n
        return [*out, _Files(held)]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for name in partition.names:
            with store.open_input_file(name) as file:
                for row in self._records(io.BufferedReader(_Raw(file), 1 << 18)):
                    rows.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 4 << 20:
                        yield _rows_batch(rows)
                        rows, size = [], 0
        yield _rows_batch(rows)

    def _records(self, file: io.BufferedReader) -> Iterator[tuple]:
        while start := file.peek(2)[:2]:
            chunks = _Member(file) if start == b"\x1f\x8b" else _Plain(file)
            while chunks.more():
                row = self._record(chunks)
                if row is not None:
                    yield row
            chunks.close()

    def _record(self, chunks: _Plain | _Member) -> tuple | None:
        """The next record; None where it isn't wanted, or only blanks are left."""
        raw = chunks.until(b"\r\n\r\n").lstrip(b"\r\n")
        if not raw.strip():
            return None
        headers = {}
        for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        length = int(headers.get("content-length") or 0)
        known = {c: headers.get(h) for c, h in HEADERS.items()}
        known["payload_digest"] = (known["payload_digest"] or "").removeprefix("sha1:") or None
        if not all(known[c] in values for c, values in self.wanted):
            chunks.skip(length)
            return None
        payload, size = None, headers.get("x-payload-length")
        if known["record_type"] != "revisit" and self.payload:
            payload = chunks.read(length)
            if headers.get("content-type", "").startswith("application/http"):
                payload = payload.partition(b"\r\n\r\n")[2]
            known["payload_digest"], size = digest(payload), len(payload)
        else:
            chunks.skip(length)
        page = _PAGE_URN.fullmatch(known["record_id"] or "")
        return known["record_id"], known["record_type"], known["target_uri"], int(page[1]) if page else None, known["refers_to"], int(size) if size is not None else None, known["payload_digest"], headers, payload


class _Raw(io.RawIOBase):
    """A pyarrow file for ``io.BufferedReader``."""

    def __init__(self, file) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)

    def seek(self, to: int, whence: int = 0) -> int:
        return self.file.seek(to, whence)

    def tell(self) -> int:
        return self.file.tell()


class _Bytes:
    """Plain bytes of records, with some read ahead; ``pull(n)`` gives up to ``n`` further ones, none at the end."""

    def __init__(self) -> None:
        self.ahead = b""

    def pull(self, n: int) -> bytes:
        raise NotImplementedError

    def more(self) -> bool:
        """Whether anything is left but the line breaks between records."""
        self.ahead = self.ahead.lstrip(b"\r\n")
        while not self.ahead:
            if not (got := self.pull(1 << 11)):
                return False
            self.ahead = got.lstrip(b"\r\n")
        return True

    def until(self, mark: bytes) -> bytes:
        """What comes before ``mark``, which is passed over; all that is left where there is none."""
        at, seen = self.ahead.find(mark), 0
        while at < 0:
            seen = max(0, len(self.ahead) - len(mark))
            if not (got := self.pull(1 << 11)):
                out, self.ahead = self.ahead, b""
                return out
            self.ahead += got
            at = self.ahead.find(mark, seen)
        out, self.ahead = self.ahead[:at], self.ahead[at + len(mark) :]
        return out

    def read(self, n: int) -> bytes:
        out, self.ahead = [self.ahead[:n]], self.ahead[n:]
        n -= len(out[0])
        while n and (got := self.pull(n)):
            out.append(got)
            n -= len(got)
        return b"".join(out)

    def skip(self, n: int) -> None:
        while n and (got := self.read(min(n, 1 << 16))):
            n -= len(got)


class _Plain(_Bytes):
    """The records of a plain archive."""

    def __init__(self, file: io.BufferedReader) -> None:
        super().__init__()
        self.file = file

    def pull(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        held = min(n, len(self.ahead))
        self.ahead = self.ahead[held:]
        self.file.seek(n - held, 1)

    def close(self) -> None:
        pass


class _Member(_Bytes):
    """The records of a gzip member, one or more.

    Where the extra field says how long the member and its plain bytes are, a skip that
    reaches the plain end goes to the next member without inflating; what follows in the
    member is then only the line breaks that end a record.
    """

    def __init__(self, file: io.BufferedReader) -> None:
        super().__init__()
        self.file, self.end, self.left, start = file, None, None, file.tell()
        head = file.read(10)
        flags = head[3]
        if flags & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    whole, self.left = struct.unpack("<II", extra[4:12])
                    self.end = start + whole
                extra = extra[4 + n :]
        for bit in (8, 16):
            if flags & bit:
                while file.read(1) not in (b"\x00", b""):
                    pass
        if flags & 2:
            file.read(2)
        self.inflate, self.held, self.passed = zlib.decompressobj(-15), b"", False

    def pull(self, n: int) -> bytes:
        while not self.passed and not self.inflate.eof:
            raw = self.held or self.file.read(1 << 14)
            if not raw:
                break
            got = self.inflate.decompress(raw, n)
            self.held = self.inflate.unconsumed_tail
            if got:
                if self.left is not None:
                    self.left -= len(got)
                return got
        return b""

    def skip(self, n: int) -> None:
        if self.left is not None and n + len(RECORD_END) >= len(self.ahead) + self.left:
            self.passed, self.ahead = True, b""
        else:
            super().skip(n)

    def close(self) -> None:
        if self.end is not None:
            self.file.seek(self.end)
            return
        while self.pull(1 << 16):
            pass
        self.file.seek(8 - len(self.inflate.unused_data), 1)


def _rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "record_type", "target_uri", "page_id", "refers_to", "payload_bytes", "payload_digest", "headers", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(names)
    columns[7] = [list(h.items()) for h in columns[7]]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``.

    Predicates reach the archives only while the session's filterPushdown setting for
    Python sources is on; Spark reads it when a query is planned, so it stays on.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def archived(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` (page_id, url, html) written to archives in the shared folder and read back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to (a page_id,
    null for responses) of each row; sizes and digests of responses are those of the
    payload that was read.  Further columns are ignored; no rows give no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_pages(pages, path, least_revisit)
    records = read_warc(spark, path)
    refers = F.regexp_extract("refers_to", r"<urn:page:(-?\d+)>", 1)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(refers != "", refers.cast("long")).alias("refers_to"))
