"""A response cache as tables: keys, time to live, near matches, eviction, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as T

LONG_TTL, SHORT_TTL = 3600, 300
THRESHOLD = 0.86
RECENT = 80


def fresh_only(query: Column, recency: Column) -> Column:
    """Whether near matches are off: recent results are asked for, or the words say so."""
    return recency.isin("day", "week") | query.rlike(f"(?i){T.FRESHNESS}")


def ttl(query: Column, recency: Column) -> Column:
    return F.when(fresh_only(query, recency), SHORT_TTL).otherwise(LONG_TTL)


def request_key(fields: dict[str, Column]) -> Column:
    """A digest of the request's fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"}), 256)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("r", F.row_number().over(latest)).where("r = 1").drop("r")


def alive(rows: DataFrame, now: float, seconds: int = 86400) -> DataFrame:
    return rows.where(F.lit(now) - F.col("created_at") <= seconds)


def exact_matches(requests: DataFrame, cached: DataFrame, now: float) -> DataFrame:
    """Requests (rid, cache_key) with the cached row (cache_key, query, created_at) of their key, if it is young enough."""
    return requests.join(alive(cached, now, LONG_TTL), "cache_key").select("rid", "cache_key", "query", F.floor(F.lit(now) - F.col("created_at")).cast("long").alias("age"))


def near_matches(requests: DataFrame, cached: DataFrame, now: float, threshold: float = THRESHOLD) -> DataFrame:
    """The most similar cached query of each request in its scope: rid, query, score.

    Both have scope, tokens, tags, numbers and max_results; cached rows also cid, query,
    recency, created_at and last_hit.  Of a scope the 80 last hit rows count, which bounds
    the join; tags and numbers must be equal, so they are part of the join key.
    """
    newest = Window.partitionBy("scope").orderBy(F.desc("last_hit"), "cid")
    recent = cached.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= RECENT)
    young = recent.where(F.floor(F.lit(now) - F.col("created_at")) <= ttl(F.col("query"), F.col("recency")))
    c = young.select("scope", "tags", "numbers", F.col("tokens").alias("ct"), F.col("max_results").alias("cm"), "cid", "query", "last_hit")
    j = requests.where(F.size("tokens") >= 4).join(c, ["scope", "tags", "numbers"]).where(F.col("cm") >= F.col("max_results"))
    scored = j.withColumn("score", T.jaccard(F.col("tokens"), F.col("ct"))).where(F.col("score") >= threshold)
    best = Window.partitionBy("rid").orderBy(F.desc("score"), F.desc("last_hit"), "cid")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").select("rid", "query", "score")


def evict(rows: DataFrame, most: int = 512) -> DataFrame:
    """The rows that stay: the last hit, then the last created ones."""
    return rows.orderBy(F.desc("last_hit"), F.desc("created_at"), "cid").limit(most)
