"""The registry of named queries, and SQL fragments that they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import text as T
from tessera.operators._lineage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name, with SQL for the same rows where there is some."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{path}/data"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


# Fragments for tables without CJK characters.
def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_\-]{{1,}}'), lambda w: w NOT IN ({listed(T.RANK_STOPWORDS)}))"


def sql_support_tokens(x: str) -> str:
    return rf"list_filter({sql_tokens(x)}, lambda w: w NOT IN ({listed(T.SUPPORT_STOPWORDS)}) AND NOT regexp_matches(w, '^[0-9]+$'))"


def sql_keywords(x: str) -> str:
    return rf"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_\-.]{{1,}}'), lambda w: trim(w, '.')), lambda w: length(w) >= 2 AND w NOT IN ({listed(T.SEARCH_STOPWORDS)}))"


def sql_clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\t-\r\x1c-\x20\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def sql_domain(x: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)), '^www\.', '')"


def sql_stem(x: str) -> str:
    return (
        f"CASE WHEN {x} IN ('does', 'was', 'has') THEN {x} WHEN length({x}) > 5 AND {x} LIKE '%ies' THEN left({x}, -3) || 'y'"
        f" WHEN length({x}) > 5 AND {x} LIKE '%ing' THEN left({x}, -3) WHEN length({x}) > 4 AND {x} LIKE '%ed' THEN left({x}, -2)"
        f" WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, -1) ELSE {x} END"
    )


def sql_fingerprint(x: str) -> str:
    return rf"list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[a-z0-9]+'), lambda w: w NOT IN ({listed(T.CACHE_STOPWORDS)})), lambda w: {sql_stem('w')}))"
