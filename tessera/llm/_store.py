"""Tables that cut lineage, in the folder that all executors share.

Every operator that has to freeze an intermediate result writes it as Parquet
below ``spark.checkpoint.dir``; a lost executor then costs one re-read of files
that are still there.  Such a table goes when the operator discards it, at the end
of a ``scratch`` scope, or else when the driver's JVM ends: results are read from
them until then.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def uri(path: str) -> str:
    """``path`` with a scheme and the slashes that every file system library takes: ``file:/x`` and ``/x`` become ``file:///x``."""
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.\-]+):)?(.*)", path, re.DOTALL).groups()
    if rest.startswith("//"):
        return path
    if scheme not in (None, "file"):
        return f"{scheme}://{rest}"
    return f"file://{rest}"


#: Bytes and rows of an Arrow batch: a task holds a batch on both sides of the pipe, and texts are long.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small, unless it asks for less still.

    Spark reads these settings when a query runs, after an operator has returned, so
    they stay set in the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, most)


def release() -> None:
    """Gives a worker's freed memory back: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_scopes: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which goes at the end of the scope or of the driver."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        files, where = _file_system(spark, path)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators freeze inside is deleted at the end: write results that read from it before that, outside of it."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(spark, *_scopes.pop())


def freeze(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (or the given one there) and read back; ``frozen`` holds the path."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.frozen = path
    return out
