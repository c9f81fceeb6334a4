"""Readers and writers: JSON lines, TREC runs, TSV judgements, spreadsheets, source trees, keyed score files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a broken line is an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.limit(limit) if limit else rows


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def read_trec(spark: SparkSession, path: str, depth: int = 0) -> DataFrame:
    """(qid, did, rank, score, run_id) of TREC run files; an error where a line has not six columns or a query's ranks are not 1 to n.

    ``depth``: keep that many first ranks of each query (0: all).
    """
    return _trec_rows(spark.read.text(path), depth)


def _trec_rows(lines: DataFrame, depth: int) -> DataFrame:
    parts = lines.where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"))
    checked = parts.select(F.when(F.size("p") == 6, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not a TREC line: "), F.array_join("p", " ")))).alias("p"))
    rows = checked.select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("did"), F.col("p")[3].cast("int").alias("rank"), F.col("p")[4].cast("double").alias("score"), F.col("p")[5].alias("run_id"))
    own = Window.partitionBy("qid")
    whole = (F.max("rank").over(own) == F.count("*").over(own)) & (F.min("rank").over(own) == 1)
    first = F.row_number().over(own.orderBy("rank")) == F.col("rank")
    rows = rows.withColumn("ok", F.when(whole & first, True).otherwise(F.raise_error(F.concat(F.lit("ranks are not 1 to n: "), F.col("qid")))))
    rows = rows.where("ok").drop("ok")
    return rows.where(F.col("rank") <= depth) if depth else rows


def trec_lines(run: DataFrame, run_id: str) -> DataFrame:
    """Lines of a TREC file for ``run`` (qid, did, rank, score)."""
    return run.select(F.format_string(f"%s Q0 %s %d %.10f {run_id}", F.col("qid").cast("string"), F.col("did").cast("string"), F.col("rank").cast("int"), "score").alias("value"))


def write_trec(run: DataFrame, path: str, run_id: str) -> None:
    trec_lines(run, run_id).repartitionByRange("value").sortWithinPartitions("value").write.text(path)


def validate_run(run: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    """(qid, problem): queries without rows or unknown, of another depth, with repeated documents or broken ranks."""
    own = run.groupBy("qid").agg(F.count("*").alias("n"), F.countDistinct("did").alias("docs"), F.countDistinct("rank").alias("ranks"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    problem = F.when(F.col("n") != depth, "depth").when(F.col("docs") != F.col("n"), "repeated document").when((F.col("ranks") != F.col("n")) | (F.col("lo") != 1) | (F.col("hi") != F.col("n")), "ranks")
    wrong = own.select("qid", problem.alias("problem")).where("problem is not null")
    missing = queries.select("qid").join(own, "qid", "left_anti").withColumn("problem", F.lit("missing"))
    extra = own.select("qid").join(queries, "qid", "left_anti").withColumn("problem", F.lit("unknown"))
    return wrong.unionByName(missing).unionByName(extra)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(qid, query) from tab-separated topics; of a repeated id the last line in order of the text counts."""
    rows = spark.read.option("sep", "\t").option("quote", "").schema("qid string, query string").csv(path)
    return rows.where("qid is not null and query is not null").groupBy("qid").agg(F.max("query").alias("query"))


def read_rows(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """JSON lines that are all whole: a broken line is an error that names its file and line, no row at all is one too.

    Files are split as usual; only one that has a broken line is read as a whole, to say where.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = parsed.where("r._broken is not null").select("path", "value").first()
    if broken:
        whole = spark.read.text(broken["path"], wholetext=True).first()["value"].split("\n")
        raise ValueError(f"broken line {broken['path']}:{whole.index(broken['value']) + 1}")
    rows = parsed.select("r.*").drop("_broken")
    if rows.isEmpty():
        raise ValueError(f"no rows in {path}")
    return rows.limit(limit) if limit else rows


def write_zip(lines: DataFrame, path: str, member: str) -> None:
    """Lines (value), in their order, as the only member of a zip archive in the folder ``path``; one task streams them, as one archive has one writer."""

    def run(frames):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open(member, "w") as inner:
            for frame in frames:
                inner.write("".join(x + "\n" for x in frame["value"]).encode())
        yield pd.DataFrame({"content": [out.getvalue()]})

    content = lines.orderBy("value").coalesce(1).mapInPandas(run, "content binary").first()["content"]
    write_file(open_store(path), f"{path}/run.zip", bytes(content))


def open_store(path: str) -> fs.FileSystem:
    """The file system of a path with or without a scheme."""
    return fs.FileSystem.from_uri(_uri(path))[0]


def _uri(path: str) -> str:
    scheme, rest = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.\-]+):)?(.*)", path).groups()
    return path if rest.startswith("//") else f"{scheme or 'file'}://{rest}"


def write_file(store: fs.FileSystem, path: str, content: bytes) -> None:
    """A small file, written by the driver."""
    own = fs.FileSystem.from_uri(_uri(path))[1]
    store.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(own) as out:
        out.write(content)


def read_trec_zip(spark: SparkSession, path: str, member: str | None = None, depth: int = 0) -> DataFrame:
    """``read_trec`` of a member of zip archives (the only text file where no name is given)."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                    own = member or (names[0] if len(names) == 1 else None)
                    if own not in names:
                        raise ValueError(f"no member {member or 'that is alone'} in the archive")
                    with archive.open(own) as lines:
                        for chunk in iter(lambda: lines.readlines(1 << 20), []):
                            yield pd.DataFrame({"value": [x.decode().rstrip("\r\n") for x in chunk]})

    return _trec_rows(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string"), depth)


def append_chunks(spark: SparkSession, corpus: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The encoded corpus (chunk, did, ...) in ``path``: chunks that are there already are not encoded again.

    ``corpus`` (chunk, did, text); each chunk is a folder, written whole or not at all by
    Spark's commit, so a run that was cut short goes on where it stopped.
    """
    try:
        done = spark.read.parquet(path).select("chunk").distinct()
    except AnalysisException:
        done = spark.createDataFrame([], corpus.select("chunk").schema)
    left = corpus.join(done, "chunk", "left_anti")
    encode(left).write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, did) with positive relevance from tab-separated judgements."""
    rows = spark.read.option("sep", "\t").schema("qid string, q0 string, did string, rel int").csv(path)
    return rows.where("rel > 0").select("qid", "did").distinct()


def check_scores(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (cid, pos) with the cached score (cid, score) of each; missing, unknown or repeated ids are an error."""
    counted = cached.withColumn("times", F.count("*").over(Window.partitionBy("cid")))
    j = counted.join(wanted, "cid", "full_outer")
    ok = F.col("score").isNotNull() & F.col("pos").isNotNull() & (F.col("times") == 1)
    return j.select("cid", "pos", F.when(ok, F.col("score")).otherwise(F.raise_error(F.concat(F.lit("ids don't match: "), F.col("cid").cast("string"))).cast("double")).alias("score"))


def candidate_ids(rows: DataFrame) -> DataFrame:
    """``rows`` (pos, qid, query, doc) with an id: a digest of the three texts and the number of the repeat."""
    digest = F.sha2(F.concat_ws("\x00", "qid", "query", "doc"), 256)
    rows = rows.withColumn("digest", digest)
    return rows.withColumn("cid", F.concat_ws(":", "digest", (F.row_number().over(Window.partitionBy("digest").orderBy("pos")) - 1).cast("string"))).drop("digest")


def source_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("py",), ignored: tuple[str, ...] = ("node_modules", "__pycache__", "venv", "dist", "build")) -> DataFrame:
    """(path, content) of source files below ``path``; hidden and ignored folders are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path)
    hidden = F.col("path").rlike(r"/(\.[^/]+|" + "|".join(ignored) + r")/")
    return rows.where(~hidden).select("path", F.decode("content", "UTF-8").alias("content"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def read_xlsx(path: str | io.BytesIO) -> dict[str, list[list[object]]]:
    """Rows of each sheet of a small workbook, on the driver: shared and inline texts, numbers; gaps are None."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        titles = [s.attrib["name"] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)]
        out = {}
        for k, title in enumerate(titles, 1):
            rows = []
            for row in ElementTree.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")).findall("m:sheetData/m:row", _NS):
                cells: list[object] = []
                for c in row.findall("m:c", _NS):
                    column = 0
                    for letter in re.match("[A-Z]+", c.attrib.get("r", "A")).group():
                        column = 26 * column + ord(letter) - 64
                    cells += [None] * (column - len(cells))
                    cells[column - 1] = _cell(c, shared)
                rows.append(cells)
            out[title] = rows
    return out


def _cell(c, shared: list[str]) -> object:
    value = c.find("m:v", _NS)
    if c.attrib.get("t") == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
    if value is None or value.text is None:
        return None
    if c.attrib.get("t") == "s":
        return shared[int(value.text)]
    try:
        return float(value.text)
    except ValueError:
        return value.text
